"""Queries of problems 4 and 6 to 8 and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import leaks, packing, percentiles, sentences
from strandframe.operators import dewey, units
from strandframe.plans.drift_queries import TRACE_VALUES
from strandframe.session import load, written

GROUP = ["metric", "grp", "run_day"]


def _day(column: str):
    return (F.year(column) * 10000 + F.month(column) * 100 + F.day(column)).cast("bigint").alias("run_day")


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, grp, run_day, value of the probe timings and the traces' realtime, each delivery once."""
    timings = load(spark, sf_dir, "probe_timings").where("timing_id IS NOT NULL")
    once = timings.groupBy("timing_id").agg(F.max(F.struct("received_at", "host", "arm", "started_at", "cpu20_s", "gpu_wall_s")).alias("t")).select("t.*")
    probe = once.select(F.concat_ws("/", "host", "arm").alias("grp"), _day("started_at"), "cpu20_s", "gpu_wall_s").unpivot(
        ["grp", "run_day"], ["cpu20_s", "gpu_wall_s"], "metric", "value"
    )
    ran = units.common_units(load(spark, sf_dir, "historical_trace"), load(spark, sf_dir, "trace_sources"), ("realtime",), keep=("submit_at",))
    real = ran.select(
        F.substring_index("entity", " (", 1).alias("grp"), _day("submit_at"), F.lit("realtime").alias("metric"), F.col("amount").cast("double").alias("value")
    )
    return probe.select(*GROUP, "value").unionByName(real.select(*GROUP, "value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a day whose 90th percentile is at least four times their median."""
    sketch = percentiles.sketches(_timings(spark, sf_dir), GROUP)
    found = percentiles.quantiles(sketch, GROUP, [0.5, 0.9])
    return found.where(F.col("quantiles")[1] >= 4 * F.col("quantiles")[0]).select(*GROUP)


def p4_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days, from the days' sketches added up."""
    sketch = percentiles.merged(percentiles.sketches(_timings(spark, sf_dir), GROUP), ["metric", "grp"])
    q = F.col("quantiles")
    return percentiles.quantiles(sketch, ["metric", "grp"], [0.5, 0.9, 0.99]).select(
        "metric", "grp", "n_values", q[0].alias("p50"), q[1].alias("p90"), q[2].alias("p99")
    )


def p4_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the summaries' timings (seconds) per arm."""
    values = dewey.elements(dewey.nodes(load(spark, sf_dir, "summaries"), "summaries", keep=dewey.ELEMENT_NODES))
    keys = ["field_name", "arm"]
    sketch = percentiles.sketches(values.select(*keys, (F.col("amount") / 1e9).alias("value")), keys)
    q = F.col("quantiles")
    return percentiles.quantiles(sketch, keys, [0.5, 0.9]).select(*keys, "n_values", q[0].alias("p50"), q[1].alias("p90"))


def p4_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each metric lie outside the range of the codes."""
    return percentiles.clamped(_timings(spark, sf_dir), ["metric"])


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "container_sizes"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that even the largest container must split."""
    sizes = load(spark, sf_dir, "container_sizes")
    largest = sizes.groupBy().agg(F.max("capacity_tokens").alias("capacity_tokens"))
    placed = _packed(spark, sf_dir).join(sizes.join(largest, "capacity_tokens", "left_semi").select("size_id"), "size_id", "left_semi")
    return placed.where("piece_no > 0").select("doc_id").distinct()


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least possible number and the fill, per capacity."""
    return packing.fill_report(_packed(spark, sf_dir), load(spark, sf_dir, "container_sizes"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity the documents placed, and what must be none: containers over capacity, texts split for no need, texts not placed whole."""
    docs, sizes = load(spark, sf_dir, "documents"), load(spark, sf_dir, "container_sizes")
    counts = written(packing.token_counts(docs))
    return packing.checks(packing.assign(counts, sizes), counts, sizes)


def _leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a test item and a document that contains it."""
    return _leaked(spark, sf_dir).select("item_id", "doc_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with the words found, the passages and the kind of match."""
    return _leaked(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentence units of all documents."""
    return sentences.sentence_units(load(spark, sf_dir, "documents"))


QUERIES = {
    "p4_found": p4_found, "p4_all_days": p4_all_days, "p4_arms": p4_arms, "p4_clamped": p4_clamped,
    "p6_found": p6_found, "p6_placed": p6_placed, "p6_fill": p6_fill, "p6_checks": p6_checks,
    "p7_found": p7_found, "p7_matches": p7_matches, "p8_found": p8_found,
}

ORACLES = {
    # Exact percentiles: no group is near the limit.
    "p4_found": TRACE_VALUES + """, probe AS (
  SELECT * FROM probe_timings WHERE timing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY timing_id ORDER BY received_at DESC NULLS LAST) = 1),
v AS (
  SELECT unnest(['cpu20_s', 'gpu_wall_s']) AS metric, concat_ws('/', host, arm) AS grp, started_at AS moment, unnest([cpu20_s, gpu_wall_s]) AS x FROM probe
  UNION ALL SELECT 'realtime', split_part(regexp_replace(task_name, '\\s+', ' ', 'g'), ' (', 1), submit_at, amount FROM val WHERE field_name = 'realtime')
SELECT metric, grp, (year(moment) * 10000 + month(moment) * 100 + day(moment))::BIGINT AS run_day FROM v WHERE x IS NOT NULL AND NOT isnan(x)
GROUP BY ALL HAVING quantile_disc(x, 0.9) >= 4 * quantile_disc(x, 0.5)""",
    "p4_clamped": TRACE_VALUES + """, probe AS (
  SELECT * FROM probe_timings WHERE timing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY timing_id ORDER BY received_at DESC NULLS LAST) = 1),
v AS (SELECT unnest(['cpu20_s', 'gpu_wall_s']) AS metric, unnest([cpu20_s, gpu_wall_s]) AS x FROM probe UNION ALL SELECT 'realtime', amount FROM val WHERE field_name = 'realtime')
SELECT metric, count(*) AS n_values, count(*) FILTER (x <> 0 AND abs(x) < pow(2.0, -50)) AS n_small, count(*) FILTER (abs(x) > pow(2.0, 77)) AS n_large FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY metric""",
    "p6_checks": """SELECT size_id, (SELECT count(*) FROM documents WHERE length(text) > 0 AND doc_id IS NOT NULL) AS n_documents,
  0::BIGINT AS n_overfull, 0::BIGINT AS n_split_needlessly, 0::BIGINT AS n_not_whole FROM container_sizes""",
}
