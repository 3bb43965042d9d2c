"""Queries over the measurement tables and the event stream, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import dewey, grouping, measures, units
from strandframe.plans.drift_queries import ELEMENT_ROWS, TRACE_VALUES
from strandframe.session import load
from strandframe.streaming import windows


def _timings(spark: SparkSession, d: str, value: str = "cpu20_s") -> DataFrame:
    return grouping.latest(load(spark, d, "probe_timings").select("timing_id", "received_at", "host", "arm", value), "timing_id", "received_at")


def _aln(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return grouping.latest(load(spark, d, "alignments").select("rec_idx", "loaded_at", *columns), "rec_idx", "loaded_at")


def _arm_summary(spark: SparkSession, d: str) -> DataFrame:
    return measures.arm_summary(_timings(spark, d), ["host", "arm"], "cpu20_s")


def _quantiles(spark: SparkSession, d: str) -> DataFrame:
    return grouping.lower_quantiles(_timings(spark, d, "gpu_wall_s"), ["host", "arm"], "gpu_wall_s", [(0, 1), (1, 4), (1, 2), (9, 10), (99, 100), (1, 1)])


def _log2(spark: SparkSession, d: str) -> DataFrame:
    span = F.abs(F.col("tlen"))
    return _aln(spark, d, "tlen").groupBy(grouping.log2_bin(span).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    events = _aln(spark, d, "tid", "flag", "pos", "body_len", "ref_len").select(
        "tid", F.col("flag").bitwiseAND(16).alias("strand"), F.least(F.floor(F.col("pos") / 100_000), F.lit(9)).cast("int").alias("bucket"),
        F.col("body_len").cast("bigint").alias("bytes"), F.col("ref_len").cast("bigint").alias("bases"), F.lit(1).cast("bigint").alias("requests"),
    )
    return measures.work_attribution(events, [("tid", "strand"), ("bucket",), ("strand",), ()], ["requests", "bytes", "bases"])


def _workers(spark: SparkSession, d: str) -> DataFrame:
    """The counters of direct and inner requests merged: each element is one worker's calls in one direction."""
    calls = dewey.elements(dewey.nodes(load(spark, d, "split_counters"), "split_counters", keep=dewey.ELEMENT_NODES))
    stats = calls.select(
        F.col("arm").alias("worker"), F.lit(1).cast("bigint").alias("requests"), F.col("amount").alias("bytes"), F.col("amount").alias("longest"),
        F.expr("shiftleft(1L, cast(elem_no as int))").alias("status"),
    )
    return measures.stat_merge(stats, ["worker"])


def _distribution(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds of CPU time by arm: quantiles and log2 histogram."""
    return measures.distribution(_timings(spark, d).withColumn("us", F.round(F.col("cpu20_s") * 1_000_000)), ["arm"], "us")


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    """CPU against device time of every host, arm and repeat."""
    runs = grouping.latest(load(spark, d, "probe_timings").select("timing_id", "received_at", "host", "arm", "rep_no", "cpu20_s", "gpu_wall_s"), "timing_id", "received_at")
    return measures.repeats(runs, ["host", "arm", "rep_no"], "cpu20_s", "gpu_wall_s")


def _checksum(spark: SparkSession, d: str) -> DataFrame:
    """Of the alignments' records, in order of ``rec_idx``."""
    return measures.checksum(_aln(spark, d, "qname", "flag", "tid", "pos", "cigar"), "rec_idx", ["qname", "flag", "tid", "pos", "cigar"])


def _capture(spark: SparkSession, d: str) -> DataFrame:
    rows = _aln(spark, d, "qname").withColumn("worker", F.substring_index("qname", ":", 2))
    return measures.bounded_capture(rows, "worker", "qname", "rec_idx", 100_000)


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    ran = units.common_units(load(spark, d, "historical_trace"), load(spark, d, "trace_sources"), ("realtime",), keep=("pct_cpu",))
    return measures.trace_rollup(ran.withColumn("process", F.substring_index("entity", " (", 1)), "process", "amount", "pct_cpu")


def _topn(spark: SparkSession, d: str) -> DataFrame:
    return _timings(spark, d).where("cpu20_s IS NOT NULL").orderBy(F.desc("cpu20_s"), "timing_id").limit(15).select("timing_id", "host", "arm", "cpu20_s")


def _cap(spark: SparkSession, d: str) -> DataFrame:
    kept = _aln(spark, d, "flag", "tid", "pos").where("flag & 4 = 0").select("tid", "pos", "rec_idx")
    return grouping.ordered_cap(kept, ["tid", "pos", "rec_idx"], 200_000)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls by direction of direct and inner requests, added up over all files."""
    rows = dewey.elements(dewey.nodes(load(spark, d, "split_counters"), "split_counters", keep=dewey.ELEMENT_NODES))
    return rows.groupBy("arm", "elem_no").agg(F.count(F.lit(1)).alias("n_elements"), F.sum("amount").alias("calls"))


def _capacity(spark: SparkSession, d: str) -> DataFrame:
    """Samples a day on twenty cores, by host, from the mean CPU seconds of the timings."""
    mean = _timings(spark, d).where("cpu20_s IS NOT NULL AND arm = 'real'").groupBy("host").agg(F.avg("cpu20_s").alias("s"))
    return mean.select("host", *[F.round(measures.samples_per_day(F.col("s") / 60, 20, u), 3).alias(f"per_day_{round(u * 100)}") for u in (0.32, 0.8)])


QUERIES = {
    "arm_summary": _arm_summary,
    "paired_ratio": lambda s, d: measures.paired_ratio(_timings(s, d), ["host"], "arm", "real", "synthetic", "cpu20_s"),
    "quantile_lower": _quantiles,
    "log2_hist": _log2,
    "imbalance_32": lambda s, d: measures.imbalance(_timings(s, d), "timing_id", F.col("cpu20_s")),
    "work_attribution": _attributed,
    "work_reconciled": lambda s, d: measures.reconciled(_attributed(s, d), ["requests", "bytes", "bases"]),
    "worker_stats": _workers,
    "bounded_capture": _capture,
    "profile_difference": lambda s, d: measures.profile_difference(_timings(s, d), "host", "arm", "real", "synthetic"),
    "probe_distribution": _distribution,
    "probe_repeats": _repeats,
    "record_checksum": _checksum,
    "trace_rollup": _rollup,
    "topn": _topn,
    "ordered_cap": _cap,
    "calls_by_direction": _calls,
    "capacity": _capacity,
    "stream_windows": windows.windowed_events,
}

_ONCE = """WITH t AS (
  SELECT * FROM probe_timings WHERE timing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY timing_id ORDER BY received_at DESC NULLS LAST) = 1)"""
_ALN = """WITH aln AS (
  SELECT * FROM alignments WHERE rec_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_idx ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_EVENTS = _ALN + """, ev AS (
  SELECT tid, flag & 16 AS strand, least(floor(pos / 100000.0), 9)::INT AS bucket, body_len::BIGINT AS bytes, ref_len::BIGINT AS bases, 1 AS requests FROM aln),
w AS (
  SELECT CASE WHEN grouping(tid) = 0 THEN 1 WHEN grouping(bucket) = 0 THEN 6 WHEN grouping(strand) = 0 THEN 5 ELSE 7 END AS level,
         tid, strand, bucket, sum(requests)::BIGINT AS requests, sum(bytes)::BIGINT AS bytes, sum(bases)::BIGINT AS bases
  FROM ev GROUP BY GROUPING SETS ((tid, strand), (bucket), (strand), ()))"""

ORACLES = {
    "calls_by_direction": "WITH e AS (" + ELEMENT_ROWS + ") SELECT arm, elem_no, count(*) AS n_elements, sum(amount)::BIGINT AS calls FROM e WHERE field_name = 'calls_by_direction' GROUP BY ALL",
    "trace_rollup": TRACE_VALUES + """SELECT split_part(regexp_replace(task_name, '\\s+', ' ', 'g'), ' (', 1) AS process, count(*) AS n_tasks, round(sum(amount) / 60000, 3) AS run_minutes,
  round(sum(amount * coalesce(try_cast(regexp_extract(pct_cpu, '([0-9.]+)', 1) AS DOUBLE), 0) / 100) / 60000, 3) AS cpu_minutes, max(amount) AS longest_ms
FROM val WHERE field_name = 'realtime' AND amount IS NOT NULL GROUP BY ALL""",
    "arm_summary": _ONCE + """ SELECT host, arm, count(*) AS n, round(avg(cpu20_s), 6) AS mean_value, round(min(cpu20_s), 6) AS min_value, round(max(cpu20_s), 6) AS max_value
FROM t WHERE cpu20_s IS NOT NULL AND NOT isnan(cpu20_s) GROUP BY host, arm""",
    "paired_ratio": _ONCE + """, m AS (SELECT host, median(cpu20_s) FILTER (arm = 'real') AS a, median(cpu20_s) FILTER (arm = 'synthetic') AS b FROM t WHERE cpu20_s IS NOT NULL GROUP BY host)
SELECT host, round(a, 6) AS base_median, round(b, 6) AS other_median, round(b / nullif(a, 0), 6) AS ratio FROM m WHERE a IS NOT NULL""",
    "quantile_lower": _ONCE + """, r AS (SELECT host, arm, gpu_wall_s AS v, row_number() OVER (PARTITION BY host, arm ORDER BY gpu_wall_s) - 1 AS i, count(*) OVER (PARTITION BY host, arm) AS n FROM t WHERE gpu_wall_s IS NOT NULL)
SELECT host, arm, any_value(n) AS n_values, min(v) FILTER (i = 0) AS q0_1, min(v) FILTER (i = (n - 1) // 4) AS q1_4, min(v) FILTER (i = (n - 1) // 2) AS q1_2,
  min(v) FILTER (i = (n - 1) * 9 // 10) AS q9_10, min(v) FILTER (i = (n - 1) * 99 // 100) AS q99_100, min(v) FILTER (i = n - 1) AS q1_1 FROM r GROUP BY host, arm""",
    "log2_hist": _ALN + " SELECT CASE WHEN tlen = 0 THEN 0 ELSE floor(log2(abs(tlen)))::INT + 1 END AS bin, count(*) AS n FROM aln GROUP BY ALL",
    "imbalance_32": _ONCE + """ SELECT timing_id // 32 AS lane_group, round(max(cpu20_s) * count(cpu20_s) / sum(cpu20_s), 6) AS imbalance FROM t GROUP BY ALL HAVING sum(cpu20_s) > 0""",
    "work_attribution": _EVENTS + " SELECT * FROM w",
    "work_reconciled": _EVENTS + " SELECT level, sum(requests)::BIGINT AS requests, sum(bytes)::BIGINT AS bytes, sum(bases)::BIGINT AS bases FROM w GROUP BY level",
    "worker_stats": "WITH e AS (" + ELEMENT_ROWS + """) SELECT arm AS worker, count(*) AS requests, sum(amount)::BIGINT AS bytes, max(amount) AS longest, bit_or((1::BIGINT << elem_no::INT)) AS status
FROM e WHERE field_name = 'calls_by_direction' GROUP BY ALL""",
    "probe_distribution": _ONCE + """, u AS (SELECT arm, round(cpu20_s * 1000000)::BIGINT AS v FROM t WHERE cpu20_s >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM u),
b AS (SELECT arm, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS b, count(*) AS c FROM u GROUP BY ALL)
SELECT arm, any_value(n) AS n_values, min(v) FILTER (i = (n - 1) // 2)::DOUBLE AS q1_2, min(v) FILTER (i = (n - 1) * 9 // 10)::DOUBLE AS q9_10, min(v) FILTER (i = (n - 1) * 99 // 100)::DOUBLE AS q99_100,
  max(v)::DOUBLE AS q1_1, round(avg(v), 6) AS mean_value, (SELECT string_agg(b.b || ':' || b.c, ',' ORDER BY b.b) FROM b WHERE b.arm IS NOT DISTINCT FROM r.arm) AS log2_histogram FROM r GROUP BY arm""",
    "probe_repeats": _ONCE + """, m AS (SELECT host, arm, rep_no, avg(cpu20_s) AS c, avg(gpu_wall_s) AS g FROM t GROUP BY ALL)
SELECT host, arm, rep_no, round(c, 9) AS cpu_s, round(g, 9) AS gpu_s, round(c / nullif(g, 0), 6) AS speedup FROM m WHERE c IS NOT NULL AND g IS NOT NULL""",
    "record_checksum": _ALN + """ SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', rec_idx, coalesce(qname, '~'), coalesce(flag::VARCHAR, '~'), coalesce(tid::VARCHAR, '~'), coalesce(pos::VARCHAR, '~'), coalesce(cigar, '~'))), 1, 15))::BIGINT)::VARCHAR AS checksum FROM aln""",
    "bounded_capture": _ALN + """, r AS (SELECT split_part(qname, ':', 1) || ':' || split_part(qname, ':', 2) AS worker, qname, min(rec_idx) AS f, count(*) AS n_records FROM aln GROUP BY ALL)
SELECT worker, qname, n_records, running FROM (SELECT *, (sum(n_records) OVER (PARTITION BY worker ORDER BY f, qname ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM r) WHERE running <= 100000""",
    "profile_difference": _ONCE + """, p AS (SELECT host, count(*) FILTER (arm = 'real') AS n_a, count(*) FILTER (arm = 'synthetic') AS n_b FROM t WHERE arm IN ('real', 'synthetic') GROUP BY host)
SELECT host, n_a, n_b, round(n_a / (SELECT sum(n_a) FROM p), 6) AS share_a, round(n_b / (SELECT sum(n_b) FROM p), 6) AS share_b FROM p""",
    "topn": _ONCE + " SELECT timing_id, host, arm, cpu20_s FROM t WHERE cpu20_s IS NOT NULL ORDER BY cpu20_s DESC, timing_id LIMIT 15",
    "ordered_cap": _ALN + " SELECT tid, pos, rec_idx FROM aln WHERE flag & 4 = 0 ORDER BY tid NULLS FIRST, pos NULLS FIRST, rec_idx LIMIT 200000",
    "capacity": _ONCE + """, m AS (SELECT host, avg(cpu20_s) AS s FROM t WHERE cpu20_s IS NOT NULL AND arm = 'real' GROUP BY host)
SELECT host, round(24.0 * 60 * 20 * 0.32 / (s / 60), 3) AS per_day_32, round(24.0 * 60 * 20 * 0.8 / (s / 60), 3) AS per_day_80 FROM m""",
    "stream_windows": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM (
  SELECT DISTINCT event_id, ts, event_type, value FROM events WHERE ts IS NOT NULL) GROUP BY ALL""",
}
