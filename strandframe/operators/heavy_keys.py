"""Per-key results where a few keys hold most records (two-stage salting).

Stage one counts rows by key (map-side combined) and keeps the keys that hold at
least ``share`` of all rows; there can be no more than ``1 / share`` of them, so
that list may be broadcast. Stage two spreads each heavy key over ``salts``
sub-keys, reduces every (key, salt) on its own and merges the partial results by
key. The salt is a hash of the record's name, not a random draw: a task that runs
again after a lost executor gives the same rows, and equal names meet in one
sub-key, so distinct counts of the partials add up exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_PLACE = -1


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """Keys holding at least ``share`` of all rows: ``keys`` + ``key_rows``.

    Null key parts form keys of their own. An empty input gives no rows. The
    result has at most ``1 / share`` rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    total = counts.agg(F.sum("key_rows")).scalar()
    return counts.where(F.col("key_rows") >= F.lit(share) * total)


def salted(df: DataFrame, keys: list[str], spread_on: Column, share: float = 0.001, salts: int = 64) -> DataFrame:
    """``df`` with a ``salt`` column: 0 for light keys, a hash of ``spread_on`` for heavy ones.

    ``df`` must not have columns named ``salt`` or ``is_heavy``.
    """
    heavy = heavy_keys(df, keys, share).select(*[F.col(k).alias(f"__heavy_{k}") for k in keys])
    on = [df[k].eqNullSafe(heavy[f"__heavy_{k}"]) for k in keys]
    flag = heavy.withColumn("is_heavy", F.lit(True))
    joined = df.join(F.broadcast(flag), on, "left").drop(*[f"__heavy_{k}" for k in keys])
    salt = F.when(F.col("is_heavy"), F.pmod(F.xxhash64(spread_on), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    return joined.withColumn("salt", salt)


def place_results(records: DataFrame, share: float = 0.001, salts: int = 64) -> DataFrame:
    """One row per (tid, pos) of ``records``: counts, distinct names and best record.

    Needs ``rec_idx, qname, flag, tid, pos, mapq, ref_len, loaded_at``; other
    columns are ignored. A record delivered again counts once, its latest delivery
    (by ``loaded_at``) stands. Null ``tid`` or ``pos`` count as -1, so all records without a
    place share the key (-1, -1). A null ``flag`` counts as 0. Null names are no
    names. The best record has the highest mapping quality (255 and null mean
    unknown and rank last), then the longest reference span, then the lowest
    ``rec_idx``. Rows whose ``rec_idx`` is null are left out: they name no record.
    Columns: tid, pos, n_records, n_mapped, n_names, best_rec_idx, best_mapq.
    """
    quality = F.when(F.col("mapq") == 255, F.lit(-1)).otherwise(F.coalesce("mapq", F.lit(-1)))
    rows = records.where(F.col("rec_idx").isNotNull()).select(
        F.coalesce(F.col("tid").cast("bigint"), F.lit(NO_PLACE).cast("bigint")).alias("tid"),
        F.coalesce(F.col("pos").cast("bigint"), F.lit(NO_PLACE).cast("bigint")).alias("pos"),
        F.col("rec_idx").cast("bigint").alias("rec_idx"),
        F.col("qname").alias("qname"),
        F.coalesce(F.col("flag"), F.lit(0)).alias("flag"),
        quality.alias("quality"),
        F.coalesce(F.col("ref_len").cast("bigint"), F.lit(0).cast("bigint")).alias("ref_len"),
        F.col("loaded_at").alias("loaded_at"),
    )
    spread = salted(rows, ["tid", "pos"], F.coalesce(F.col("qname"), F.col("rec_idx").cast("string")), share, salts)
    key = ["tid", "pos", "salt"]
    # One exchange: all three aggregates below are clustered by (tid, pos, salt).
    parts = spread.repartition(*key)
    once = parts.groupBy(*key, "rec_idx").agg(F.max(F.struct("loaded_at", "qname", "flag", "quality", "ref_len")).alias("r"))
    mapped = ((F.col("r.flag").bitwiseAND(4) == 0) & (F.col("tid") >= 0)).cast("bigint")
    best = F.struct(F.col("r.quality").alias("quality"), F.col("r.ref_len").alias("ref_len"), (-F.col("rec_idx")).alias("neg_idx"))
    by_name = once.groupBy(*key, F.col("r.qname").alias("qname")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(mapped).alias("m"), F.max(best).alias("b")
    )
    partial = by_name.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("qname").alias("names"), F.max("b").alias("b")
    )
    merged = partial.groupBy("tid", "pos").agg(
        F.sum("n").alias("n_records"), F.sum("m").alias("n_mapped"), F.sum("names").alias("n_names"), F.max("b").alias("b")
    )
    return merged.select(
        "tid", "pos", "n_records", "n_mapped", "n_names",
        (-F.col("b.neg_idx")).alias("best_rec_idx"), F.col("b.quality").cast("int").alias("best_mapq"),
    )


def crowded_places(places: DataFrame, share: float = 0.01) -> DataFrame:
    """Places holding at least ``share`` of all mapped records; input from :func:`place_results`."""
    total = places.agg(F.sum("n_mapped")).scalar()
    return places.where((F.col("n_mapped") > 0) & (F.col("n_mapped") >= F.lit(share) * total))
