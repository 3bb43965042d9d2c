"""Test passages inside a training corpus (a distributed positional inverted index).

The index holds every word of the corpus: a row is the posting list of one term in one block of
documents, its positions ascending. Rows are spread over the cluster by term, and the lists of
frequent terms by block as well, so no list is whole in one place. It is written once per corpus
and knows nothing of the test items; any set of items is searched on it.

A search joins the items' words to the terms (also to those with one wrong letter), which
gives the frequencies that order each item's pairs of neighbouring words. The lists so found
meet by block. There the lists of a pair, shifted by their offset, are intersected, the rarest
pairs first, and nominate documents; in these all lists of the item are intersected, the
passages on each diagonal are read, joined in the item's order, and the words in them counted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from strandframe.session import written

_CJK = "々぀-ヿ㐀-䶿一-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_FORMAT = re.compile("[­​-‏⁠﻿]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])")
#: A passage has at least this many words (characters for scripts without spaces) at a stretch; an item shorter than that must stand whole.
STRETCH, STRETCH_CJK = 4, 6
#: Words that may stand in place of right ones inside a passage, if they are no item's; one sign, whatever it is, for Chinese and Japanese.
GAP, GAP_CJK = 2, 1
#: Words up to this length are taken as they are, longer ones also with a wrong letter.
LEAST_FUZZY = 4
#: Tokens of one block, a task's unit of work; the slices over which the lists of one term are spread.
BLOCK, SLICES = 1_000_000, 64
#: Items that one task searches in a block.
ITEMS = 5_000
#: Positions left free between two documents of a block.
APART = 4


def tokens(text: str) -> list[str]:
    """Words in lower case and one form; characters for Chinese and Japanese.

    Compatibility forms, case, accents written apart, soft hyphens, zero-width marks,
    hyphens at line ends and punctuation make no difference.
    """
    text = _FORMAT.sub("", unicodedata.normalize("NFKC", text)).casefold()
    if "-\n" in text or "‐" in text or "- \n" in text:
        text = _HYPHEN.sub("", text)
    return _TOKEN.findall(text)


def by_character(words: list[str]) -> bool:
    """Whether an item is counted in characters: most of its tokens are single CJK signs."""
    return 2 * sum(len(w) == 1 and ord(w) > 0x2E80 for w in words) > len(words)


_INDEX = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("postings", pa.binary())])


def _lists(words: list[str], lengths: list[int], ids: list[int], block: int) -> pa.RecordBatch:
    """The posting lists of a block (gaps between positions), and under the empty term its documents with start and end."""
    size = np.array(lengths, dtype=np.int64)
    starts = np.cumsum(size + APART) - size - APART
    codes, terms = pd.factorize(np.array(words, dtype=object))
    order = np.argsort(codes, kind="stable")
    places = (np.arange(len(words)) + APART * np.repeat(np.arange(len(size)), size))[order]
    counts = np.bincount(codes, minlength=len(terms))
    first = np.cumsum(counts) - counts
    gaps = np.diff(places, prepend=0)
    gaps[first] = places[first]
    # The bytes of a list's gaps by rank: the high ones are nearly all zero and take no room once compressed.
    ranked = gaps.astype("<i4").view("u1").reshape(-1, 4)
    data = np.concatenate([ids, starts, starts + size]).astype("<i8").tobytes() + b"".join(ranked[f : f + c].T.tobytes() for f, c in zip(first, counts))
    head = 24 * len(ids)
    ends = np.concatenate([[0, head], head + 4 * (first + counts)]).astype("<i4")
    lists = pa.Array.from_buffers(pa.binary(), len(terms) + 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [pa.array(["", *terms]), pa.array(np.full(len(terms) + 1, block)), pa.array(np.concatenate([[len(ids)], counts])), lists], schema=_INDEX
    )


def _post(most: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that runs again reads the same rows in the same order and so numbers its blocks alike.
        block = TaskContext.get().partitionId() << 24
        words, lengths, ids = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens(text)
                if found:
                    words += found
                    lengths.append(len(found))
                    ids.append(doc_id)
                if len(words) >= most:
                    yield _lists(words, lengths, ids, block)
                    words, lengths, ids, block = [], [], [], block + 1
        if words:
            yield _lists(words, lengths, ids, block)

    return post


def index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_tokens: int = BLOCK) -> DataFrame:
    """The positional inverted index: term, block, n, postings; written once, to be searched for any items.

    A block is about ``block_tokens`` tokens of whole documents, with a little space between them; ``postings`` are
    the gaps between a term's positions in the block, ``n`` their number. The empty term lists the
    block's documents with start and end. Null and empty texts, texts without words and rows
    without an id have no postings. The id must be unique; other columns are ignored.
    """
    docs = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    lists = docs.mapInArrow(_post(block_tokens), "term string, block bigint, n bigint, postings binary")
    slice_ = F.pmod(F.shiftright("block", 24) + F.col("block"), F.lit(SLICES))
    return written(lists.repartition("term", slice_).sortWithinPartitions("term", "block"), "zstd")


@F.pandas_udf(ArrayType(StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: tokens(t or ""))


@F.pandas_udf(BooleanType())
def _by_character(words: pd.Series) -> pd.Series:
    return words.map(lambda w: by_character(list(w)))


def _shortened(word: str) -> Column:
    """A word, and what is left of it when one letter is taken out: (key, whole)."""
    w = F.col(word)
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.struct(F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))).alias("key"), F.lit(False).alias("whole")))
    return F.array_distinct(F.concat(F.array(F.struct(w.alias("key"), F.lit(True).alias("whole"))), F.when(F.length(w) > LEAST_FUZZY, cut).otherwise(F.filter(cut, lambda _: F.lit(False)))))


def meanings(postings: DataFrame, item_terms: DataFrame) -> DataFrame:
    """Which terms of the index stand for which words of the items: word, term, n (how often the corpus has it).

    A term stands for the item word it equals, else for the only item word from which one letter
    makes it differ: missing (looked at first), too many, wrong or swapped. Words of up to
    ``LEAST_FUZZY`` letters, or with other signs than letters, only stand for themselves.
    """
    vocabulary = postings.where("term <> ''").groupBy(F.col("term").alias("word")).agg(F.sum("n").alias("n"))
    exact = vocabulary.join(item_terms, F.col("word") == F.col("term")).select("word", "term", "n")
    asked = item_terms.select("term", F.inline(_shortened("term"))).where(F.col("whole") | F.col("term").rlike(r"^\p{L}+$"))
    others = vocabulary.join(item_terms, F.col("word") == F.col("term"), "left_anti").where(F.length("word") > LEAST_FUZZY)
    seen = others.select("word", "n", F.inline(_shortened("word"))).withColumnRenamed("whole", "as_is")
    met = seen.join(asked, "key").groupBy("word", "n").agg(F.collect_set(F.when(F.col("as_is"), F.col("term"))).alias("missing"), F.collect_set("term").alias("any"))
    near = met.select("word", F.when(F.size("missing") == 1, F.col("missing")[0]).when(F.size("any") == 1, F.col("any")[0]).alias("term"), "n")
    return exact.unionByName(near.where("term IS NOT NULL"))


def plans(items: DataFrame, meant: DataFrame, least: float, left_out: float) -> DataFrame:
    """How each item is searched: item_id, words, cjk, begins, need.

    ``begins`` says for each pair of neighbouring words whether it nominates documents. A match holds at least
    ``least / 2`` times the item's words as such pairs; the commonest pairs, up to the share ``left_out`` of
    that number, are left out, and a document must hold ``need`` of the others. An item of one word is its own pair.
    """
    n_words = F.size("words")
    often = meant.groupBy("term").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("item_id").orderBy("place")
    each = items.where(n_words > 0).select("item_id", "size", F.posexplode("words").alias("place", "term")).join(often, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pairs = each.withColumn("n", F.least("n", F.lead("n", 1).over(order))).where((F.col("place") < F.col("size") - 1) | (F.col("size") == 1))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("n").desc(), "place"))
    want = F.greatest(F.ceil(F.col("size") * least / 2), F.lit(1))
    skipped = F.least(F.floor(want * left_out), want - 1)
    begins = pairs.withColumn("begins", rank > skipped).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "begins"))), lambda x: x["begins"]).alias("begins"))
    return items.join(begins, "item_id").select("item_id", "words", "cjk", "begins", F.least(want - skipped, F.size("begins").cast("bigint")).cast("int").alias("need"))


def in_order(runs: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Most item words in passages that follow each other in both texts, and how many passages these are."""
    runs = sorted(runs)
    best: list[tuple[int, int]] = []
    for k, (i, d, n) in enumerate(runs):
        top = (0, 0)
        for m in range(k):
            pi, pd_, pn = runs[m]
            skip = max(0, pi + pn - i, pd_ + pn - d)
            if pi < i and pd_ < d and skip < n:
                top = max(top, (best[m][0] - skip, best[m][1]))
        best.append((top[0] + n, top[1] + 1))
    return max(best, default=(0, 0))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from ``low`` up to ``high`` of each range, and which range each is of."""
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which], which


def _runs(owner: np.ndarray, place: np.ndarray, at: np.ndarray, span: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All passages from pairs of right words: owner, item place, document place, length.

    On each diagonal a pair that begins where the one before it ends goes on with its passage.
    """
    line = at - place
    order = np.lexsort((span, place, line, owner))
    owner, place, line, end = owner[order], place[order], line[order], (place + span)[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1]) | (place[1:] > end[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(order))[: len(first)] - 1
    words = end[last] - place[first] + 1
    long = words >= stretch[owner[first]]
    first, words = first[long], words[long]
    return owner[first], place[first], place[first] + line[first], words


class _Block:
    """The posting lists of one block that some item asks for."""

    def __init__(self, lists: pd.DataFrame):
        documents = np.frombuffer(b"".join(lists.loc[lists["term"] == "", "postings"]), dtype="<i8").reshape(3, -1)
        self.ids, self.starts, self.ends = documents
        lists = lists[lists["term"] != ""]
        self.number = {t: k + 1 for k, t in enumerate(sorted(set(lists["term"])))}
        of = lists["term"].map(self.number).to_numpy(dtype=np.int64)
        places = [np.cumsum(np.frombuffer(p, dtype="u1").reshape(4, -1).T.copy().view("<i4").ravel(), dtype=np.int64) for p in lists["postings"]]
        term = np.repeat(of, [len(p) for p in places])
        places = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        # One list per item word, one after the other; and the list each position is in, for intersections.
        order = np.lexsort((places, term))
        self.places = places[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.number) + 2))
        self.holds = np.zeros(int(self.ends[-1]) + 2 * APART, dtype=np.int32)
        self.holds[places] = term
        # Terms and places as one ascending number, to find a document's part of a list.
        self.width = len(self.holds)
        self.key = term[order] * self.width + self.places

    def terms(self, words) -> np.ndarray:
        return np.array([self.number.get(w, 0) for w in words], dtype=np.int64)

    def part(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of terms within bounds, and which of the terms each belongs to."""
        at, which = _ranges(np.searchsorted(self.key, term * self.width + low), np.searchsorted(self.key, term * self.width + high))
        return self.places[at], which

    def meet(self, a: np.ndarray, b: np.ndarray, span: np.ndarray, low=None, high=None) -> tuple[np.ndarray, np.ndarray]:
        """Where list ``b`` shifted by ``span`` meets list ``a``: the places of a, and which pair each is of. The rarer list is read."""
        size = self.first[1:] - self.first[:-1]
        lead = size[a] <= size[b]
        term = np.where(lead, a, b)
        if low is None:
            at, which = _ranges(self.first[term], self.first[term + 1])
            place = self.places[at]
        else:
            place, which = self.part(term, low, high)
        place = np.where(lead[which], place, place - span[which])
        end = place + span[which]
        ok = (place >= 0) & (end < self.width)
        place, end, which = place[ok], end[ok], which[ok]
        ok = (self.holds[place] == a[which]) & (self.holds[end] == b[which])
        return place[ok], which[ok]


def _search(least: float):
    def search(lists: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        block, rows = _Block(lists), []
        terms = [block.terms(w) for w in items["words"]]
        size = np.array([len(t) for t in terms], dtype=np.int64)
        cjk = items["cjk"].to_numpy(dtype=bool)

        def pairs(span: int, of: np.ndarray, picked=None):
            """First and second term, item number and place of the items' pairs ``span`` apart that the block can hold."""
            parts = [(n, *((t, t) if len(t) == 1 and span == 1 else (t[:-span], t[span:])), picked[n] if picked else None) for n, t in ((n, terms[n]) for n in of)]
            a = np.concatenate([x[1] for x in parts] or [size[:0]])
            b = np.concatenate([x[2] for x in parts] or [size[:0]])
            owner = np.repeat([x[0] for x in parts] or size[:0], [len(x[1]) for x in parts] or size[:0])
            place = np.concatenate([np.arange(len(x[1])) for x in parts] or [size[:0]])
            ok = (a > 0) & (b > 0)
            if picked:
                ok &= np.concatenate([np.asarray(x[3], dtype=bool) for x in parts] or [ok])
            return a[ok], b[ok], owner[ok], place[ok]

        # Documents that hold enough of an item's rarest neighbouring words, each pair looked up once.
        a, b, owner, place = pairs(1, np.arange(len(terms)), items["begins"].tolist())
        code, which = np.unique(a * len(block.first) + b, return_inverse=True)
        first, second = code // len(block.first), code % len(block.first)
        single = size[owner] == 1
        spans = np.ones(len(code), dtype=np.int64)
        at, pair = block.meet(first, second, spans)
        doc = np.searchsorted(block.starts, at, "right") - 1
        held = np.unique(pair * len(block.ids) + doc)
        pair, doc = held // len(block.ids), held % len(block.ids)
        cut = np.searchsorted(pair, np.arange(len(code) + 1))
        hit, of = _ranges(cut[which], cut[which + 1])
        hit, of = hit[~single[of]], of[~single[of]]
        candidate, steps = np.unique(owner[of] * len(block.ids) + doc[hit], return_counts=True)
        enough = steps >= items["need"].to_numpy()[candidate // len(block.ids)]
        alone = [n * len(block.ids) + np.unique(np.searchsorted(block.starts, block.places[block.first[t] : block.first[t + 1]], "right") - 1)
                 for n, t in ((n, t[0]) for n, t in enumerate(terms) if len(t) == 1) if t]
        candidate = np.concatenate([candidate[enough], *alone]).astype(np.int64)
        item, doc = candidate // len(block.ids), candidate % len(block.ids)

        # All passages of a candidate's item in its document.
        found: list[tuple[np.ndarray, ...]] = []
        near = np.zeros(len(candidate), dtype=np.int64)
        by_item = np.argsort(item, kind="stable")
        cut = np.searchsorted(item[by_item], np.arange(len(terms) + 1))
        wanted = np.nonzero(cut[1:] > cut[:-1])[0]
        for span in range(1, GAP + 2):
            a, b, owner, place = pairs(span, wanted[(size[wanted] > 1) & ((span <= GAP_CJK + 1) | ~cjk[wanted])])
            at, of = _ranges(cut[owner], cut[owner + 1])
            who = by_item[at]
            hits, which = block.meet(a[of], b[of], np.full(len(of), span), block.starts[doc[who]], block.ends[doc[who]])
            who, place = who[which], place[of][which]
            inside = (hits >= block.starts[doc[who]]) & (hits + span < block.ends[doc[who]])
            for k in range(1, span):
                inside &= (block.holds[hits + k] == 0) | cjk[item[who]]
            who, place, hits = who[inside], place[inside], hits[inside]
            found.append((who, place, hits, np.full(len(who), span)))
            if span == 1 and len(who):
                # Neighbouring words of the item that the document has side by side, each place once.
                wide = int(size.max()) + 1
                near += np.bincount(np.unique(who * wide + place) // wide, minlength=len(candidate))
        lone = np.nonzero(size[item] == 1)[0]
        for c in lone:
            hits, _ = block.part(terms[item[c]][:1], block.starts[doc[c] : doc[c] + 1], block.ends[doc[c] : doc[c] + 1])
            found.append((np.full(len(hits), c), np.zeros(len(hits), np.int64), hits, np.zeros(len(hits), np.int64)))
            near[c] = 1
        who, place, hits, span = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        stretch = np.minimum(size, np.where(cjk, STRETCH_CJK, STRETCH))
        who, place, hits, words = _runs(who, place, hits, span, stretch[item])
        enough = (np.bincount(who, words, len(candidate)) >= least * size[item]) & (near >= np.maximum(np.ceil(size[item] * least / 2), 1).clip(max=np.maximum(size[item] - 1, 1)))
        cut = np.searchsorted(who, np.arange(len(candidate) + 1))
        for c in np.nonzero(enough)[0]:
            mine = slice(cut[c], cut[c + 1])
            runs = list(zip(place[mine].tolist(), hits[mine].tolist(), words[mine].tolist()))
            total = int(size[item[c]])
            # Passages in order hold no more of the item than all passages together.
            if len({w for i, _, m in runs for w in range(i, i + m)}) < least * total:
                continue
            count, passages = in_order(runs)
            if count >= least * total:
                kind = "phrase" if passages == 1 and count == total else "proximity"
                rows.append((items["item_id"].iat[item[c]], block.ids[doc[c]], total, count, passages, kind))
        return pd.DataFrame(rows, columns=["item_id", "doc_id", "n_words", "n_found", "n_passages", "kind"])

    return search


def matches(postings: DataFrame, items: DataFrame, least: float = 0.5, left_out: float = 0.5) -> DataFrame:
    """item_id, doc_id, n_words, n_found, n_passages, kind for every item that a document of the index holds.

    A document holds an item if passages in the item's order hold at least ``least`` of its words, and pairs of
    neighbouring item words that stand side by side in it are at least half as many. Items with the same id
    keep the first text by order; items without an id or without words match nothing, and items shorter than a stretch must stand
    whole. ``kind`` is ``phrase`` where the whole item stands in one passage, else ``proximity``.
    ``left_out`` only says how many of the commonest pairs are spared in the nomination: the result is the same for each
    value from 0 (every pair is looked up) to 1. Extra columns are ignored.
    """
    once = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("item_text").alias("text"))
    worded = once.select("item_id", _words("text").alias("words")).where(F.size("words") > 0).select("item_id", "words", _by_character("words").alias("cjk"), F.size("words").alias("size"))
    worded = written(worded)
    item_terms = worded.select(F.explode("words").alias("term")).distinct()
    meant = written(meanings(postings, item_terms))
    slices = worded.agg(F.ceil(F.count(F.lit(1)) / ITEMS)).scalar()
    part = F.pmod(F.xxhash64("item_id"), F.greatest(slices, F.lit(1))).alias("part")
    planned = written(plans(worded, meant, least, left_out)).select("*", part)
    # Posting lists of the terms that stand for some item's word, and the blocks that can hold an item: those with enough of its words.
    lists = postings.join(meant.select(F.col("word").alias("term"), F.col("term").alias("means")), "term")
    needed = lists.select("block", F.col("means").alias("term"), "postings")
    held = lists.select("block", F.col("means").alias("term")).distinct()
    asked = planned.select("item_id", "part", "need", F.explode("words").alias("term"))
    asked = asked.groupBy("item_id", "part", "need", "term").agg(F.count(F.lit(1)).alias("times"))
    pairs = held.join(asked, "term").groupBy("block", "part", "item_id", "need").agg(F.sum("times").alias("times")).where("times >= need").select("block", "part", "item_id")
    pairs = written(pairs)
    wanted = pairs.join(planned.drop("part"), "item_id")
    blocks = postings.where("term = ''").select("block", "term", "postings")
    tasks = wanted.select("block", "part").distinct()
    sent = needed.unionByName(blocks).join(tasks, "block").select(F.col("block").alias("of_block"), F.col("part").alias("of_part"), "term", "postings")
    return sent.groupBy("of_block", "of_part").cogroup(wanted.groupBy("block", "part")).applyInPandas(
        _search(least), "item_id bigint, doc_id bigint, n_words int, n_found int, n_passages int, kind string"
    )


def leaked(documents: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """Every pair of a test item and a document that holds at least ``least`` of its words: :func:`matches` on a fresh :func:`index`.

    ``documents`` may hold a text under several ids; each counts. Extra columns are ignored.
    """
    return matches(index(documents), items, least)
