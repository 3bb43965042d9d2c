"""Filling containers of fixed capacity with documents, measured in tokens.

A text longer than the capacity is cut into full pieces, which fill containers of their own,
and a rest. Rests and whole texts are spread by hash over shards of bounded size; a shard
packs its items best-fit first and then searches locally among its underfull containers: it
moves an item, exchanges one for one or two for one, always raising the sum of squared
fills, until the emptiest containers run empty or no exchange helps. The containers that are
still underfull, a small part, are pooled, dealt anew over fewer shards and searched again, twice.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import written

#: Items of one shard, and of one shard of the underfull containers: their search takes time in proportion to the square.
SHARD, POOL = 20_000, 4_000
#: How often the containers that are still underfull are pooled, dealt anew over shards and searched.
ROUNDS = 2
#: Capacities asked for at once: they are literals of the plan.
MOST_SIZES = 1_000
PLACED = "size_id int, container_id string, doc_id bigint, piece_no int, n_tokens int, tok_start bigint"


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the installed public tokenizer keeps its ranks."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document with text; null and empty texts have no tokens and no row, nor has a row without an id.

    Strings that look like special tokens are ordinary text.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path(), pattern or public_tokenizers.PATTERN

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array([len(encode(t)) for t in batch["text"]], "int64")})

    docs = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).mapInPandas(count, "doc_id bigint, n_tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin: the longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins that raise the sum of squared fills; empty bins are dropped.

    The emptiest bin gives: an item to a bin with room, one item for a smaller one, or two
    items for a smaller one. Of all such exchanges the one that raises the sum most is made, until
    none is left; then the next bin gives. The sum grows with each step, so it ends.
    """
    bins = [list(b) for b in bins]
    size = np.array(sizes, dtype=np.int64)
    fill = np.array([int(size[b].sum()) if b else 0 for b in bins], dtype=np.int64)
    done = [b for b in range(len(bins)) if fill[b] >= capacity]
    under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    loose = np.array([i for b in under for i in bins[b]], dtype=np.int64)
    holder = np.zeros(len(size), dtype=np.int64)
    for b in under:
        holder[bins[b]] = b
    partners = np.zeros(len(bins), dtype=bool)
    partners[under] = True
    for giver in under:
        while bins[giver]:
            takes = partners & (fill >= fill[giver]) & (fill < capacity)
            takes[giver] = False
            open_bins = np.nonzero(takes)[0]
            if not len(open_bins):
                break
            item = loose[takes[holder[loose]]]
            owner = np.concatenate([open_bins, holder[item]])
            back = np.concatenate([np.zeros(len(open_bins), np.int64), size[item]])
            room, lead = capacity - fill[owner], fill[owner] - fill[giver]
            mine = bins[giver]
            # Offers of one size are as good as each other.
            offers = {int(size[i]): (i,) for i in mine}
            offers |= {t: (i, j) for k, i in enumerate(mine) for j in mine[k + 1 :] if (t := int(size[i] + size[j])) not in offers}
            best, pick = 0, None
            for total, offer in offers.items():
                gain = total - back
                worth = np.where((gain > 0) & (gain <= room), gain * (lead + gain), 0)
                k = int(worth.argmax())
                if worth[k] > best:
                    best, pick = int(worth[k]), (offer, k)
            if pick is None:
                break
            offer, k = pick
            to = int(owner[k])
            for i in offer:
                mine.remove(i)
                bins[to].append(i)
                holder[i] = to
            if k >= len(open_bins):
                returned = int(item[k - len(open_bins)])
                bins[to].remove(returned)
                mine.append(returned)
                holder[returned] = giver
            moved = int(size[list(offer)].sum()) - int(back[k])
            fill[to] += moved
            fill[giver] -= moved
    return [bins[b] for b in [*done, *under] if bins[b]]


def _pack(level: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        """Packs one shard of one capacity; at later levels the containers come as they are."""
        group = group.sort_values(["doc_id", "piece_no"]).reset_index(drop=True)
        capacity, sizes = int(group["capacity"].iat[0]), group["n_tokens"].tolist()
        if level == 0:
            bins = best_fit(sizes, capacity)
        else:
            bins = [list(v) for _, v in sorted(group.groupby("container_id").groups.items())]
        bins = local_search(sizes, bins, capacity)
        shard = int(group["shard"].iat[0])
        number = np.zeros(len(group), dtype=np.int64)
        full = np.zeros(len(group), dtype=bool)
        for b, items in enumerate(bins):
            number[items] = b
            full[items] = sum(sizes[i] for i in items) >= capacity
        out = group[["size_id", "capacity", "doc_id", "piece_no", "n_tokens", "tok_start"]].copy()
        out["container_id"] = [f"{level}-{shard}-{b}" for b in number]
        out["is_full"] = full
        return out

    return pack


_PACKED = "size_id int, capacity bigint, doc_id bigint, piece_no int, n_tokens bigint, tok_start bigint, container_id string, is_full boolean"


def assign(counts: DataFrame, capacities: DataFrame, shard_items: int = SHARD, pool_items: int = POOL, rounds: int = ROUNDS) -> DataFrame:
    """Containers of every capacity: size_id, container_id, doc_id, piece_no, n_tokens, tok_start.

    ``counts`` has doc_id (unique) and n_tokens, ``capacities`` (a few fixed rows) size_id and
    capacity_tokens. Only a text longer than the capacity has more than one piece. Documents
    with null or no tokens, and capacities that are null or not positive, give no rows.
    Extra columns are ignored.
    """
    fixed = capacities.select(F.col("size_id").cast("int"), F.col("capacity_tokens").cast("bigint").alias("capacity")).where("capacity > 0").distinct().limit(MOST_SIZES + 1).collect()
    if len(fixed) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} capacities")
    size = F.struct(F.lit(0).alias("size_id"), F.lit(0).cast("bigint").alias("capacity"))
    sizes = F.array(*[F.struct(F.lit(r.size_id).alias("size_id"), F.lit(r.capacity).cast("bigint").alias("capacity")) for r in fixed]) if fixed else F.filter(F.array(size), lambda _: F.lit(False))
    counted = counts.select("doc_id", F.col("n_tokens").cast("bigint")).where("n_tokens > 0")
    each = counted.select("doc_id", "n_tokens", F.inline(sizes))
    n, c = F.col("n_tokens"), F.col("capacity")
    cut = each.select(
        "size_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), ((n - 1) / c).cast("int"))).alias("piece_no"), n.alias("whole")
    ).withColumn("tok_start", F.col("piece_no") * c).withColumn("n_tokens", F.least(c, F.col("whole") - F.col("tok_start"))).drop("whole")
    full = cut.where(F.col("n_tokens") == c)
    rest = cut.where(F.col("n_tokens") < c)

    def spread(items: DataFrame, key, level: int, most: int) -> DataFrame:
        shards = items.groupBy("size_id").agg(F.ceil(F.count(F.lit(1)) / most).alias("shards"))
        sharded = items.join(F.broadcast(shards), "size_id").withColumn("shard", F.pmod(F.xxhash64(*key), F.col("shards")).cast("int"))
        return sharded.drop("shards").groupBy("size_id", "shard").applyInPandas(_pack(level), _PACKED)

    columns = ["size_id", "container_id", "doc_id", "piece_no", "n_tokens", "tok_start"]
    done = full.withColumn("container_id", F.format_string("d-%d-%d", "doc_id", "piece_no")).select(*columns)
    level = written(spread(rest, ["doc_id", "piece_no"], 0, shard_items))
    for turn in range(1, rounds + 1):
        done = done.unionByName(level.where("is_full").select(*columns))
        level = written(spread(level.where(~F.col("is_full")), ["container_id", F.lit(turn)], turn, pool_items))
    return done.unionByName(level.select(*columns))


def packed(documents: DataFrame, capacities: DataFrame, **options) -> DataFrame:
    """:func:`assign` for documents, whose token counts are written once and read twice."""
    return assign(written(token_counts(documents, **options)), capacities)


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """size_id, capacity_tokens, n_containers, n_tokens, least_containers, fill of a packing."""
    per = placed.groupBy("size_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(capacities.select("size_id", "capacity_tokens"), "size_id").select(
        "size_id", "capacity_tokens", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )


def checks(placed: DataFrame, counts: DataFrame, capacities: DataFrame) -> DataFrame:
    """size_id, n_documents, n_overfull, n_split_needlessly, n_not_whole: the last three are 0 for a right packing.

    Containers over their capacity; texts in pieces though they fit; texts whose pieces are not just their tokens, each once and in order.
    """
    sized = placed.join(capacities.select(F.col("size_id").cast("int"), F.col("capacity_tokens").cast("bigint").alias("capacity")), "size_id")
    held = sized.groupBy("size_id", "container_id", "capacity").agg(F.sum("n_tokens").alias("n"))
    over = held.groupBy("size_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_overfull"))
    piece = F.struct("tok_start", (F.col("tok_start") + F.col("n_tokens")).alias("end"))
    docs = sized.groupBy("size_id", "doc_id", "capacity").agg(F.array_sort(F.collect_list(piece)).alias("p")).join(counts.select("doc_id", F.col("n_tokens").alias("whole")), "doc_id", "full")
    inner = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i)["tok_start"] == F.when(i == 1, 0).otherwise(F.element_at("p", F.greatest(i - 1, F.lit(1)))["end"]))
    right = F.coalesce(inner & (F.element_at("p", -1)["end"] == F.col("whole")), F.lit(False))
    per = docs.groupBy("size_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if((F.size("p") > 1) & (F.col("whole") <= F.col("capacity"))).alias("n_split_needlessly"), F.count_if(~right).alias("n_not_whole")
    )
    return per.join(over, "size_id").select("size_id", "n_documents", "n_overfull", "n_split_needlessly", "n_not_whole")
