"""Grouping operators: mates, duplicates, two-level histograms, ranks, caps and lower quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.functions.flags import FIRST, NOT_EXAMINED, SECOND, has, lacks
from strandframe.session import materialise


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per ``key``, the one with the greatest ``by`` (ties: the greatest row); null keys are left out.

    Columns whose types have no order (maps) are not supported.
    """
    rest = [c for c in df.columns if c not in (key, by)]
    parted = df.where(F.col(key).isNotNull()).select(key, F.struct(by, *rest).alias("__r")).repartition(key)
    best = parted.groupBy(key).agg(F.max("__r").alias("__r"))
    return best.select(key, "__r.*")


def quality_score(qual: Column, least: int = 15) -> Column:
    """The score by which a record is kept among duplicates: the sum of its base qualities of at least ``least`` (null qualities: 0)."""
    good = F.filter(qual, lambda q: q >= least)
    return F.coalesce(F.aggregate(good, F.lit(0).cast("bigint"), lambda acc, q: acc + q), F.lit(0).cast("bigint"))


def fragment_ends(aln: DataFrame, score: Column) -> DataFrame:
    """Examined records with their unclipped 5' end and score: rec_idx, qname, flag, tid, pos, end_key, score."""
    operations = cigar.ops(F.col("cigar"))
    shaped = aln.where(lacks(NOT_EXAMINED)).select("rec_idx", "qname", "flag", "tid", "pos", operations.alias("ops"), score.cast("bigint").alias("score"))
    reverse = has(0x10)
    place = F.when(reverse, F.col("pos") + cigar.reference_length(F.col("ops")) - 1 + cigar.trailing_clip(F.col("ops"))).otherwise(
        F.col("pos") - cigar.leading_clip(F.col("ops"))
    )
    return shaped.select(
        "rec_idx", "qname", "flag", "tid", "pos", "score",
        F.struct(F.col("tid").cast("bigint").alias("tid"), place.cast("bigint").alias("pos"), reverse.alias("reverse")).alias("end_key"),
    )


def mate_pairs(records: DataFrame, *extra: str) -> DataFrame:
    """One row per name with a usable pair: qname, a, b (the records as structs).

    Of the records of a name, in order of ``rec_idx``, the first with bit 0x40 and the first with
    bit 0x80 form a pair if both are paired with a mapped mate; one record with both bits
    pairs with itself. Null names form no pair.
    """
    row = F.struct("rec_idx", "flag", *extra)
    firsts = records.where(F.col("qname").isNotNull()).groupBy("qname").agg(
        F.min(F.when(has(FIRST), row)).alias("a"), F.min(F.when(has(SECOND), row)).alias("b")
    )
    usable = (F.col("a.flag").bitwiseAND(9) == 1) & (F.col("b.flag").bitwiseAND(9) == 1)
    return firsts.where(F.col("a").isNotNull() & F.col("b").isNotNull() & usable)


def duplicates(aln: DataFrame, score: Column) -> DataFrame:
    """Records judged for duplication: rec_idx, is_pair, is_duplicate.

    Among pairs with the same two ends the highest summed score stays, ties go to the record
    first in coordinate order; among singles with the same end likewise, but where any
    pair has that end no single stays. ``aln`` holds each record once; secondary,
    supplementary and unmapped records are not judged. Null positions sort first.
    """
    ends = fragment_ends(aln, score)
    pairs = mate_pairs(ends, "tid", "pos", "score", "end_key").select(
        F.least("a.end_key", "b.end_key").alias("low"), F.greatest("a.end_key", "b.end_key").alias("high"),
        (F.col("a.score") + F.col("b.score")).alias("score"),
        F.least(F.struct("a.tid", "a.pos", "a.rec_idx"), F.struct("b.tid", "b.pos", "b.rec_idx")).alias("place"),
        F.col("a.rec_idx").alias("a"), F.col("b.rec_idx").alias("b"),
    )
    # The best of each group is an aggregate that is reduced before it is sent, so a crowded
    # place is no single task; the groups' rows meet it in a join, whose skew Spark can split.
    best = pairs.groupBy("low", "high").agg(F.min(F.struct(-F.col("score"), "place", "a", "b")).alias("best"))
    ranked = pairs.join(best, ["low", "high"]).withColumn("is_duplicate", F.col("a") != F.col("best.a"))
    members = ranked.select("is_duplicate", F.explode(F.array_distinct(F.array("a", "b"))).alias("rec_idx"))
    singles = ends.join(members.select("rec_idx"), "rec_idx", "left_anti").select("rec_idx", "tid", "pos", "score", "end_key")
    pair_ends = pairs.select(F.explode(F.array("low", "high")).alias("end_key"), F.lit(True).alias("paired"))
    order = F.struct(-F.col("score"), "tid", "pos", "rec_idx")
    of_end = singles.select("end_key", order.alias("o")).unionByName(pair_ends, allowMissingColumns=True).groupBy("end_key").agg(
        F.min("o").alias("best"), F.coalesce(F.max("paired"), F.lit(False)).alias("paired")
    )
    judged = singles.join(of_end, "end_key").select("rec_idx", F.lit(False).alias("is_pair"), (F.col("paired") | (F.col("rec_idx") != F.col("best.rec_idx"))).alias("is_duplicate"))
    return members.select("rec_idx", F.lit(True).alias("is_pair"), "is_duplicate").unionByName(judged)


def two_level_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur how often: occurrence, n_keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence")).groupBy("occurrence").agg(F.count(F.lit(1)).alias("n_keys"))


def _numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` range-partitioned and kept, with ``__part``; and per partition the rows before it."""
    parts = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # One row per partition: their number does not grow with the rows of a partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts, sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based rank in a total order, without one task holding all rows.

    Rows are range-partitioned and kept; each partition numbers its rows, and the sizes of
    the partitions before it (one number each) are added.
    """
    parts, offsets = _numbered(df, order)
    inside = Window.partitionBy("__part").orderBy(*order)
    ranked = parts.withColumn("__n", F.row_number().over(inside)).join(F.broadcast(offsets), "__part")
    return ranked.withColumn(name, F.col("__n") + F.col("__before")).drop("__part", "__n", "__before")


def ordered_cap(df: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first ``most`` rows in a total order (a feature of the reports that use it); all of them with None.

    By rank, as in :func:`global_rank`: no task gets the first rows of all others. Only
    the partitions that begin before the cap are sorted.
    """
    if most is None:
        return df
    parts, offsets = _numbered(df, order)
    inside = Window.partitionBy("__part").orderBy(*order)
    near = parts.join(F.broadcast(offsets.where(F.col("__before") < most)), "__part")
    return near.withColumn("__n", F.row_number().over(inside)).where(F.col("__n") + F.col("__before") <= most).drop("__part", "__n", "__before")


def values_at(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at given 0-based ranks of each key's sorted values: ``keys``, n_values and a column per rank.

    ``ranks`` are expressions of the column ``n_values``. Null and NaN values do not count. Equal
    values are counted first; counts per narrow bucket of values (1/256 of a doubling) say which
    bucket holds a rank, and only that bucket is sorted, so a large key is no single task.
    """
    v = F.col(value)
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    size = F.floor((F.log2(F.abs(v)) + 1100) * 256)
    counted = counted.withColumn("__b", F.when(v == 0, F.lit(0)).when(v < 0, -size).otherwise(size))
    order = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counted.groupBy(*keys, "__b").agg(F.sum("__c").alias("__m")).withColumns({
        "__before": F.coalesce(F.sum("__m").over(order), F.lit(0)), "n_values": F.sum("__m").over(Window.partitionBy(*keys)),
    })
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    wanted = buckets.select("*", asked.alias("__r")).where((F.col("__r.rank") >= F.col("__before")) & (F.col("__r.rank") < F.col("__before") + F.col("__m")))
    near = counted.join(wanted.select(*keys, "__b", "n_values", F.col("__r.name").alias("__name"), (F.col("__r.rank") - F.col("__before")).alias("__left")), [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hit = near.withColumn("__upto", F.sum("__c").over(inside)).where(F.col("__upto") > F.col("__left"))
    return hit.groupBy(*keys).agg(F.max("n_values").alias("n_values"), *[F.min(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in ranks])


def lower_quantiles(df: DataFrame, keys: list[str], value: str, parts: list[tuple[int, int]]) -> DataFrame:
    """The element at index ``floor((n - 1) * p / q)`` of each key's sorted values, no interpolation.

    Columns: ``keys``, n_values, and ``q<p>_<q>`` per entry of ``parts``.
    """
    n = F.col("n_values")
    return values_at(df, keys, value, {f"q{p}_{q}": F.floor((n - 1) * p / q) for p, q in parts})


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median_value") -> DataFrame:
    """The median per key, the mean of the two middle values where their number is even."""
    n = F.col("n_values")
    two = values_at(df, keys, value, {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)})
    return two.select(*keys, "n_values", ((F.col("__low") + F.col("__high")) / 2).alias(name))


def log2_bin(value: Column) -> Column:
    """0 for 0, else k with 2^(k-1) <= value < 2^k."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value))).cast("int")
