"""Longest exact matches of read pieces in a reference, on both strands.

The reference is cut into overlapping pieces; each piece gives the numbers of its words of K
bases. Requests meet the words by equality, so the search is a join: words that occur give
candidates, whose texts are compared further, the best length per request stands with the number
of places that reach it. Requests whose first K bases occur nowhere are settled by counts of the
shorter words. The result is that of an interval search in a sorted suffix array: the longest
prefix found anywhere and how many suffixes share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.session import materialise

#: Bases of a word; a request is at most ``LONGEST`` bases.
K, LONGEST, PIECE = 12, 4_096, 32_768
#: Places of one word that one salt holds.
HOT = 10_000
_CODE = np.full(256, 4, dtype=np.int64)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def pieces(references: DataFrame, piece: int = PIECE) -> DataFrame:
    """tid, strand (0 forward, 1 reverse complement), piece_no, text: pieces that overlap by the longest request.

    Bases other than ACGT match nothing. Null sequences give no piece.
    """
    plain = F.regexp_replace(F.upper("seq"), "[^ACGT]", ".")
    both = references.where(F.length("seq") > 0).select("tid", F.posexplode(F.array(plain, reverse_complement(plain))).alias("strand", "seq"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A sequence is walked through once, whatever its length."""
        for batch in batches:
            for row in batch.itertuples():
                for no, at in enumerate(range(0, len(row.seq), piece)):
                    yield pd.DataFrame({"tid": [row.tid], "strand": row.strand, "piece_no": no, "text": row.seq[at : at + piece + LONGEST]})

    return both.mapInPandas(run, "tid int, strand int, piece_no int, text string").repartition("tid", "strand", "piece_no")


def _words(text: str, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places of the words of ``k`` bases that begin in the first ``most`` places."""
    code = _CODE[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]
    n = min(len(code) - k + 1, most)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for i in range(k):
        word = word * 4 + code[i : i + n]
        bad |= code[i : i + n] > 3
    at = np.nonzero(~bad)[0]
    return word[at], at


def word_index(cut: DataFrame, k: int = K, piece: int = PIECE) -> DataFrame:
    """word, tid, strand, pos of every word of ``k`` bases of the reference (each place once)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                word, at = _words(row.text, k, piece)
                yield pd.DataFrame({"word": word, "tid": row.tid, "strand": row.strand, "pos": at + row.piece_no * piece})

    return cut.mapInPandas(run, "word bigint, tid int, strand int, pos bigint")


def word_counts(cut: DataFrame, k: int = K, piece: int = PIECE) -> DataFrame:
    """size, word, n for all words of up to ``k`` bases, added up within each task before they are sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                for size in range(1, k + 1):
                    word, n = np.unique(_words(text, size, piece)[0], return_counts=True)
                    yield pd.DataFrame({"size": size, "word": word, "n": n})

    return cut.select("text").mapInPandas(run, "size int, word bigint, n bigint").groupBy("size", "word").agg(F.sum("n").alias("n"))


def _number(text: Column) -> Column:
    """A short text of ACGT as a number in base four; null for other letters."""
    return F.when(text.rlike("^[ACGT]+$"), F.conv(F.translate(text, "ACGT", "0123"), 4, 10).cast("bigint"))


def common_prefix(a: Column, b: Column, most: int = LONGEST) -> Column:
    """Length of the longest common prefix, by halving: equality of prefixes is monotone."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    least = F.least(F.length(a), F.length(b))
    fits = lambda acc, p: (acc + p <= least) & (F.left(a, acc + p) == F.left(b, acc + p))
    return F.aggregate(steps, F.lit(0), lambda acc, p: F.when(fits(acc, p), acc + p).otherwise(acc))


def search(requests: DataFrame, references: DataFrame, k: int = K, piece: int = PIECE) -> DataFrame:
    """req_id, length, n_places of the longest prefix of each request that occurs in the reference.

    ``requests`` has req_id (unique) and query, a text of bases in reading direction (for
    requests that read backwards, the reverse complement). A request without any match has
    length 0 and all suffixes as places, as an empty prefix has. Null and empty queries have
    no row; a query of more than ``LONGEST`` bases is an error. Extra columns are ignored.
    Requests with the same query are searched once. The places of a frequent first word, a repeat of the reference,
    are spread over as many salts as they fill, and the requests that begin with it are sent to each.
    """
    cut = pieces(references, piece)
    named = requests.where(F.length("query") > 0).select("req_id", F.upper("query").alias("query"))
    named = named.withColumn("query", F.when(F.length("query") <= LONGEST, F.col("query")).otherwise(F.raise_error(F.lit(f"queries have at most {LONGEST} bases"))))
    asked = named.select("query").distinct().withColumn("req_id", F.col("query"))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda s: s <= F.length("query"))
    short = asked.select("req_id", F.explode(sizes).alias("size"), "query").select("req_id", "size", _number(F.left("query", F.col("size"))).alias("word"))
    counts = word_counts(cut, k, piece)
    by_count = short.join(counts, ["size", "word"]).groupBy("req_id").agg(F.max(F.struct("size", "n")).alias("s"))
    long = asked.where(F.length("query") > k).withColumn("word", _number(F.left("query", F.lit(k))))
    # Words with more places than one salt holds: at most a share of 1 / HOT of all places.
    often = counts.where((F.col("size") == k) & (F.col("n") > HOT)).select("word", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    spread = long.join(often, "word", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    salt = F.pmod(F.xxhash64("tid", "strand", "pos"), F.coalesce("salts", F.lit(1))).cast("int")
    known = word_index(cut, k, piece).join(often, "word", "left").withColumn("salt", salt).drop("salts")
    places = spread.join(known, ["word", "salt"]).withColumn("piece_no", F.floor(F.col("pos") / piece).cast("int"))
    seen = places.join(cut, ["tid", "strand", "piece_no"]).select(
        "req_id", common_prefix(F.col("query"), F.expr(f"substring(text, cast(pos % {piece} as int) + 1, length(query))")).alias("length")
    )
    by_text = seen.groupBy("req_id", "length").agg(F.count(F.lit(1)).alias("n")).groupBy("req_id").agg(F.max(F.struct("length", "n")).alias("t"))
    total = references.agg(F.coalesce(2 * F.sum(F.length("seq")), F.lit(0))).scalar()
    found = asked.join(by_count, "req_id", "left").join(by_text, "req_id", "left").select(
        "query", F.coalesce("t.length", "s.size", F.lit(0)).alias("length"), F.coalesce("t.n", "s.n", total).cast("bigint").alias("n_places")
    )
    return named.join(found, "query").select("req_id", "length", "n_places")


def chain(requests: DataFrame, references: DataFrame, least: int = 5, steps: int = 8, k: int = K, piece: int = PIECE) -> DataFrame:
    """Searches the rest of each request after every match: req_id, step, start, length, n_places.

    It goes on while at least ``least`` bases are left and the last match was not empty, for at
    most ``steps`` steps (a limit of the format). A base that matches nothing ends the chain.
    """
    left, out = requests.select("req_id", "query", F.lit(0).alias("start")), None
    for step in range(steps):
        left = left.where(F.length("query") >= least)
        # Written each round: the plan of a round does not repeat the rounds before it.
        found = materialise(left.join(search(left, references, k, piece), "req_id").where("length > 0"))
        rows = found.select("req_id", F.lit(step).alias("step"), "start", "length", "n_places")
        out = rows if out is None else out.unionByName(rows)
        left = found.select("req_id", F.expr("substring(query, length + 1)").alias("query"), (F.col("start") + F.col("length")).alias("start"))
    return out
