"""Interval algebra on half-open [start, end) rows keyed by any columns.

Joins cut the axis into bins and meet by (key, bin) equality, so Spark hashes or sorts them like
any join; a pair is kept in the one bin where both begin, so nothing is emitted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _binned(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width)
    return df.withColumn(name, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], width: int = 4096,
    left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("r_start", "r_end"),
) -> DataFrame:
    """All pairs of one key whose half-open intervals overlap.

    ``keys`` have the same names on both sides, other columns different ones. Empty
    intervals overlap nothing; null bounds and null keys match nothing. ``width`` should be
    near the length of the longer side's usual interval.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = _binned(left.where(F.col(ls) < F.col(le)), ls, le, width, "__bin")
    b = _binned(right.where(F.col(rs) < F.col(re_)), rs, re_, width, "__bin")
    here = F.floor(F.greatest(F.col(ls), F.col(rs)) / width)
    return a.join(b, [*keys, "__bin"]).where((F.col(rs) < F.col(le)) & (F.col(re_) > F.col(ls)) & (F.col("__bin") == here)).drop("__bin")


def stab_join(points: DataFrame, right: DataFrame, keys: list[str], point: str = "point", width: int = 4096,
              right_span: tuple[str, str] = ("r_start", "r_end"), closed_start: bool = True) -> DataFrame:
    """Points inside intervals: ``start <= p < end``, or ``start < p < end`` with ``closed_start=False``."""
    rs, re_ = right_span
    a = points.withColumn("__bin", F.floor(F.col(point) / width).cast("bigint"))
    b = _binned(right.where(F.col(rs) < F.col(re_)), rs, re_, width, "__bin")
    after = F.col(point) >= F.col(rs) if closed_start else F.col(point) > F.col(rs)
    return a.join(b, [*keys, "__bin"]).where(after & (F.col(point) < F.col(re_))).drop("__bin")


def union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union per key as disjoint intervals; touching ones merge. Empty and null intervals are left out."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(end).over(before)
    fresh = (reached.isNull() | (F.col(start) > reached)).cast("int")
    return (
        df.where(F.col(start) < F.col(end)).select(*keys, start, end).withColumn("__new", fresh)
        .withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
    )


def _steps(df: DataFrame, keys: list[str], deltas: list[Column]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*deltas)))


def depth(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1 << 20) -> DataFrame:
    """Runs of equal depth above zero: ``keys``, start, end, depth (a sweep over the ends).

    Ends at one place are added up before the sweep (map-side combined) and places where
    nothing changes are dropped, so neighbours of one depth are one run. The running sum
    goes by blocks of ``width`` places: the sums of whole blocks are carried forward, so a
    long key is no single task.
    """
    ends = _steps(df.where(F.col(start) < F.col(end)), keys, [
        F.struct(F.col(start).cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("d")),
        F.struct(F.col(end).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("d")),
    ])
    changed = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d")).where("d != 0").withColumn("block", F.floor(F.col("at") / width))
    by_key = Window.partitionBy(*keys).orderBy("block")
    blocks = changed.groupBy(*keys, "block").agg(F.sum("d").alias("net"), F.min("at").alias("first")).select(
        *keys, "block", F.coalesce(F.sum("net").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"),
        F.lead("first").over(by_key).alias("next_first"),
    )
    inside = Window.partitionBy(*keys, "block").orderBy("at")
    runs = changed.join(blocks, [*keys, "block"]).select(
        *keys, F.col("at").alias("start"), F.coalesce(F.lead("at").over(inside), F.col("next_first")).alias("end"),
        (F.col("carried") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"),
    )
    return runs.where((F.col("depth") > 0) & F.col("end").isNotNull())


def subtract(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Left without right, per key: both are united first, then one sweep keeps what is in left alone."""
    a, b = union(left, keys, start, end), union(right, keys, start, end)

    def steps(df, side, sign):
        on, off = F.lit(sign), F.lit(-sign)
        zero = F.lit(0)
        return _steps(df, keys, [
            F.struct(F.col(start).alias("at"), (on if side else zero).alias("a"), (zero if side else on).alias("b")),
            F.struct(F.col(end).alias("at"), (off if side else zero).alias("a"), (zero if side else off).alias("b")),
        ])

    marks = steps(a, True, 1).unionByName(steps(b, False, 1)).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.select(*keys, F.col("at").alias(start), F.lead("at").over(order).alias(end), F.sum("a").over(upto).alias("in_a"), F.sum("b").over(upto).alias("in_b"))
    # Two pieces that touch were parted by an empty cut and are one.
    return union(swept.where("in_a > 0 AND in_b = 0"), keys, start, end)


def covered(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``keys`` and bases: the summed length of the rows."""
    return df.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).cast("bigint").alias("bases"))
