"""Measurement analytics: arms, ratios, imbalance, work partitions, traces, profiles and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.grouping import log2_bin, lower_quantiles, medians


def arm_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least and greatest value and number of repeats per group; null values do not count."""
    kept = runs.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.min(value), 6).alias("min_value"), F.round(F.max(value), 6).alias("max_value")
    )


def paired_ratio(runs: DataFrame, keys: list[str], arm: str, base: str, other: str, value: str) -> DataFrame:
    """Median of one arm over the median of another per group: ``keys``, base_median, other_median, ratio.

    Groups without the base arm have no row; the ratio is null where the other arm is missing
    or the base is 0.
    """
    each = medians(runs.where(F.col(arm).isin(base, other)), [*keys, arm], value)
    middle = F.col("median_value")
    wide = each.groupBy(*keys).agg(F.max(F.when(F.col(arm) == base, middle)).alias("base_median"), F.max(F.when(F.col(arm) == other, middle)).alias("other_median"))
    return wide.where("base_median IS NOT NULL").select(
        *keys, F.round("base_median", 6).alias("base_median"), F.round("other_median", 6).alias("other_median"),
        F.round(F.try_divide("other_median", "base_median"), 6).alias("ratio"),
    )


def imbalance(df: DataFrame, position: str, work: Column, width: int = 32) -> DataFrame:
    """Per group of ``width`` neighbours by position: greatest work times the size over the sum; groups without work have no row."""
    grouped = df.select(F.floor(F.col(position) / width).alias("lane_group"), work.alias("work")).groupBy("lane_group").agg(
        F.max("work").alias("most"), F.count("work").alias("n"), F.sum("work").alias("total")
    )
    return grouped.where("total > 0").select("lane_group", F.round(F.col("most") * F.col("n") / F.col("total"), 6).alias("imbalance"))


def work_attribution(events: DataFrame, dimensions: list[tuple[str, ...]], measures: list[str]) -> DataFrame:
    """One pass over the events for several groupings at once (grouping sets); ``level`` is Spark's grouping id.

    Every grouping adds up to the same total, which :func:`reconciled` checks.
    """
    columns = list(dict.fromkeys(c for d in dimensions for c in d))
    sets = [[F.col(c) for c in d] for d in dimensions]
    sums = [F.sum(m).alias(m) for m in measures]
    return events.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().cast("int").alias("level"), *sums).select("level", *columns, *measures)


def reconciled(attribution: DataFrame, measures: list[str]) -> DataFrame:
    """Per level the totals of a work attribution: they must be equal."""
    return attribution.groupBy("level").agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])


def stat_merge(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Search statistics of workers merged: sums, one maximum and one bit set."""
    return stats.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"), F.max("longest").alias("longest"), F.bit_or("status").alias("status")
    )


def bounded_capture(records: DataFrame, worker: str, read: str, order: str, cap: int) -> DataFrame:
    """The first whole reads of each worker whose records stay within ``cap`` (a feature of the capture).

    Reads are counted before they are added up, so a worker's window has a row per read. The
    capture of a worker ends at its first read that does not fit.
    """
    reads = records.groupBy(worker, read).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("n_records"))
    order_by = Window.partitionBy(worker).orderBy("__first", read)
    # A read has a record at least, so no more than the first ``cap`` reads can fit; the rest go before the shuffle.
    reads = reads.withColumn("__nth", F.row_number().over(order_by)).where(F.col("__nth") <= cap).drop("__nth")
    upto = order_by.rowsBetween(Window.unboundedPreceding, 0)
    return reads.withColumn("running", F.sum("n_records").over(upto)).where(F.col("running") <= cap).drop("__first")


def profile_difference(samples: DataFrame, key: str, arm: str, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Shares of samples per key in two arms and their difference, missing keys as 0 (a full outer join by pivoting)."""
    w = F.col(weight) if weight else F.lit(1)
    per = samples.where(F.col(arm).isin(a, b)).groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col(arm) == a, w)), F.lit(0)).alias("n_a"), F.coalesce(F.sum(F.when(F.col(arm) == b, w)), F.lit(0)).alias("n_b")
    )
    totals = per.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"))
    share = lambda c, t: F.round(F.coalesce(F.try_divide(F.col(c), totals.select(t).scalar()), F.lit(0.0)), 6)
    return per.select(key, "n_a", "n_b", share("n_a", "a").alias("share_a"), share("n_b", "b").alias("share_b"))


def trace_rollup(tasks: DataFrame, name: str, milliseconds: str, percent_cpu: str) -> DataFrame:
    """Per process: tasks, run time in minutes, CPU minutes and the longest run."""
    cpu = F.coalesce(F.regexp_extract(percent_cpu, r"([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    return tasks.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.round(F.sum(milliseconds) / 60_000, 3).alias("run_minutes"),
        F.round(F.sum(F.col(milliseconds) * cpu / 100) / 60_000, 3).alias("cpu_minutes"), F.max(milliseconds).alias("longest_ms"),
    )


def samples_per_day(cpu_minutes: Column, cores: int, utilisation: float) -> Column:
    """Capacity of a box: minutes of a day times busy cores over the CPU minutes of a sample."""
    return F.try_divide(F.lit(24.0 * 60 * cores * utilisation), cpu_minutes)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side``: empty if the two are equal as multisets."""
    columns = a.columns
    left = a.exceptAll(b.select(*columns)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*columns).exceptAll(a).withColumn("side", F.lit("right")))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, lower quantiles (1/2, 9/10, 99/100), greatest value and log2 histogram of whole numbers per group.

    The histogram is text, ``bin:count`` in order of the bins (at most 64): bin 0 for 0, k for 2^(k-1) up to 2^k - 1. Nulls and
    negative numbers do not count; groups without values have no row.
    """
    kept = df.where(F.col(value) >= 0).select(*keys, F.col(value).cast("bigint").alias("__v"))
    bins = kept.groupBy(*keys, log2_bin(F.col("__v")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__v").cast("decimal(38,0)")).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "n"))), lambda x: F.concat_ws(":", x["b"].cast("string"), x["n"].cast("string"))), ",")
    shape = bins.groupBy(*keys).agg(text.alias("log2_histogram"), F.round(F.sum("s").cast("double") / F.sum("n"), 6).alias("mean_value"))
    return lower_quantiles(kept.withColumn("__v", F.col("__v").cast("double")), keys, "__v", [(1, 2), (9, 10), (99, 100), (1, 1)]).join(shape, keys)


def repeats(runs: DataFrame, keys: list[str], cpu: str, gpu: str) -> DataFrame:
    """One row per repeat of a comparison: ``keys``, cpu_s, gpu_s (means where a repeat has several) and speedup."""
    each = runs.groupBy(*keys).agg(F.avg(cpu).alias("cpu_s"), F.avg(gpu).alias("gpu_s")).where("cpu_s IS NOT NULL AND gpu_s IS NOT NULL")
    return each.select(*keys, F.round("cpu_s", 9).alias("cpu_s"), F.round("gpu_s", 9).alias("gpu_s"), F.round(F.try_divide("cpu_s", "gpu_s"), 6).alias("speedup"))


def checksum(df: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """One row, n_rows and checksum: equal for equal rows at equal positions, in whatever order and parts they are read.

    Each row's text begins with its position, so rows that change places change the sum; nulls differ from empty texts.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in (position, *columns)])
    short = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(short), F.lit(0)).cast("string").alias("checksum"))
