"""CIGAR strings as column functions.

All take the operation array of :func:`ops`; a null, empty or ``*`` CIGAR has none. The three
block rules differ on purpose: coverage counts M, = and X and jumps D and N; the QC blocks
count M alone and let soft clips advance, but not = and X; introns advance over all that
consumes the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = ("M", "D", "N", "=", "X")
ALIGNED = ("M", "I", "=", "X")


def ops(cigar: Column) -> Column:
    """``array<struct<len:int,op:string>>`` of a CIGAR text."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), 1).cast("array<int>")
    names = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=XB])"), 2)
    return F.coalesce(F.zip_with(lengths, names, lambda a, b: F.struct(a.alias("len"), b.alias("op"))), F.array().cast("array<struct<len:int,op:string>>"))


def total(operations: Column, which: tuple[str, ...]) -> Column:
    """Sum of the lengths of the operations in ``which``."""
    return F.aggregate(operations, F.lit(0), lambda acc, x: acc + F.when(x["op"].isin(*which), x["len"]).otherwise(0))


def reference_length(operations: Column) -> Column:
    return total(operations, REFERENCE)


def query_length(operations: Column) -> Column:
    """Aligned query bases: M, I, = and X."""
    return total(operations, ALIGNED)


def leading_clip(operations: Column) -> Column:
    """Bases clipped (S and H) before the first other operation; an all-clipped CIGAR counts whole."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(acc, x):
        over = acc["over"] | ~x["op"].isin("S", "H")
        return F.struct((acc["n"] + F.when(over, 0).otherwise(x["len"])).alias("n"), over.alias("over"))

    return F.aggregate(operations, start, step, lambda acc: acc["n"])


def trailing_clip(operations: Column) -> Column:
    return leading_clip(F.reverse(operations))


def _spans(position: Column, operations: Column, emit: tuple[str, ...], advance: tuple[str, ...]) -> Column:
    """Half-open intervals of the ``emit`` operations from a walk in which ``advance`` ones move on."""
    kind = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(position.cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc, x):
        here, after = acc["at"], acc["at"] + x["len"]
        grown = F.concat(acc["spans"], F.array(F.struct(here.alias("start"), after.alias("end"))))
        return F.struct(
            F.when(x["op"].isin(*advance), after).otherwise(here).alias("at"),
            F.when(x["op"].isin(*emit), grown).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(operations, start, step, lambda acc: acc["spans"])


def coverage_blocks(position: Column, operations: Column) -> Column:
    """Blocks of M, = and X; D and N leave a gap; clips, I and P do not move."""
    return _spans(position, operations, ("M", "=", "X"), REFERENCE)


def qc_blocks(position: Column, operations: Column) -> Column:
    """Blocks of M; D, N and S move on, = and X are passed over (as the QC tools do)."""
    return _spans(position, operations, ("M",), ("M", "D", "N", "S"))


def introns(position: Column, operations: Column) -> Column:
    """Intervals of N."""
    return _spans(position, operations, ("N",), REFERENCE)
