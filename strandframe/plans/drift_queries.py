"""Queries of problems 1 to 3 and 5 (general data preparation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.operators import dewey, heavy_keys, lifespans, units
from strandframe.session import load, written


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifespan rows, written once: every query of them reads them several times."""
    return written(lifespans.drift(load(spark, sf_dir, "source_sha256"), load(spark, sf_dir, "summaries")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field added, removed, renamed or retyped, with the file where it happened."""
    return lifespans.changes(_drift(spark, sf_dir)).select("file_id", "field_name", "change_kind").distinct()


def p1_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: one row per producer, field and lifespan."""
    return lifespans.lifespans(lifespans.drift(load(spark, sf_dir, "source_sha256"), load(spark, sf_dir, "summaries")))


def p1_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias table: lineage name and type of every lifespan."""
    rows = _drift(spark, sf_dir)
    return lifespans.alias_table(rows, lifespans.changes(rows))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files read into one consistent table under their lineage names."""
    rows = _drift(spark, sf_dir)
    return lifespans.unified(rows, lifespans.alias_table(rows, lifespans.changes(rows)))


def p1_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that did not fit the type of their lineage."""
    return lifespans.failed_casts(p1_unified(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str, keep: str | None = None) -> DataFrame:
    a = dewey.nodes(load(spark, sf_dir, "summaries"), "summaries", keep=keep)
    return a.unionByName(dewey.nodes(load(spark, sf_dir, "split_counters"), "split_counters", keep=keep))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-null element of the timings and the calls by direction."""
    rows = dewey.elements(_nodes(spark, sf_dir, dewey.ELEMENT_NODES))
    return rows.select("file_id", "run_no", "arm", "field_name", "elem_no", "amount").distinct()


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of files: the roots of all other tables."""
    return dewey.files(_nodes(spark, sf_dir, "^$"))


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of runs and lanes, each with the label of what holds them."""
    return dewey.runs(_nodes(spark, sf_dir, dewey.RUN_NODES))


def p2_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of arms of both sources, each with the label of its parent (file, run or part of a lane)."""
    return dewey.arms(_nodes(spark, sf_dir, dewey.ARM_NODES))


def p2_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of single elements, each with its own label and its arm's."""
    return dewey.elements(_nodes(spark, sf_dir, dewey.ELEMENT_NODES))


def p2_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other scalar of the files with its schema path and the label of its parent."""
    return dewey.details(_nodes(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.place_results(load(spark, sf_dir, "alignments"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that hold at least one percent of the mapped records."""
    return heavy_keys.crowded_places(_places(spark, sf_dir)).select("tid", "pos")


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct names and best record of every place."""
    return _places(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in milliseconds and sizes in bytes."""
    values = units.common_units(load(spark, sf_dir, "historical_trace"), load(spark, sf_dir, "trace_sources"))
    return values.where("field_name IN ('duration', 'peak_rss', 'rchar')").select("trace_id", "field_name", "amount")


def p5_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialect with its factor and the estimate from linked tasks."""
    return units.scales(written(units.figures(load(spark, sf_dir, "historical_trace"), load(spark, sf_dir, "trace_sources"))))


QUERIES = {
    "p1_found": p1_found, "p1_lifespans": p1_lifespans, "p1_aliases": p1_aliases, "p1_unified": p1_unified, "p1_failed_casts": p1_failed_casts,
    "p2_found": p2_found, "p2_files": p2_files, "p2_runs": p2_runs, "p2_arms": p2_arms, "p2_elements": p2_elements, "p2_details": p2_details,
    "p3_found": p3_found, "p3_places": p3_places, "p5_found": p5_found, "p5_scales": p5_scales,
}

_ONCE = """
WITH once AS (
  SELECT rec_idx, coalesce(tid, -1)::BIGINT AS tid, coalesce(pos, -1)::BIGINT AS pos, qname, coalesce(flag, 0) AS flag,
         CASE WHEN mapq IS NULL OR mapq = 255 THEN -1 ELSE mapq END AS quality, coalesce(ref_len, 0) AS ref_len
  FROM alignments WHERE rec_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rec_idx ORDER BY loaded_at DESC NULLS LAST) = 1
), places AS (
  SELECT tid, pos, count(*)::BIGINT AS n_records, count(*) FILTER (flag & 4 = 0 AND tid >= 0)::BIGINT AS n_mapped,
         count(DISTINCT qname)::BIGINT AS n_names,
         first(rec_idx ORDER BY quality DESC, ref_len DESC, rec_idx)::BIGINT AS best_rec_idx, max(quality)::INT AS best_mapq
  FROM once GROUP BY tid, pos
)
"""

_LIVES = r"""
WITH RECURSIVE f AS (
  SELECT 'a' AS src, * FROM source_sha256 WHERE file_id IS NOT NULL AND evidence_dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1
  UNION ALL SELECT 'b', * FROM summaries WHERE file_id IS NOT NULL AND evidence_dir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1),
o AS (SELECT *, row_number() OVER w AS seq, lead(file_id) OVER w AS next_id FROM f WINDOW w AS (PARTITION BY src, evidence_dir ORDER BY captured_at, file_id)),
raw AS (
  SELECT src, evidence_dir, file_id, next_id, seq, t.type, t.atom->>'$' AS val,
         array_to_string(list_transform(regexp_extract_all(substr(t.fullkey, 2), '\.("[^"]*"|[^."\[]+)', 1), lambda x: trim(x, '"')), '>') AS field
  FROM o, json_tree(o.payload) t WHERE src = 'a' AND t.type <> 'OBJECT' AND NOT contains(regexp_replace(t.fullkey, '"[^"]*"', '', 'g'), '[')
  UNION ALL SELECT src, evidence_dir, file_id, next_id, seq, t.type, t.atom->>'$', t.key FROM o, json_each(o.payload) t WHERE src = 'b'),
r AS (
  SELECT *, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'float' WHEN type = 'VARCHAR' THEN 'string' WHEN type <> 'NULL' THEN lower(type) END AS jt FROM raw),
marks AS (
  SELECT *, lag(seq) OVER w AS prev, lead(seq) OVER w AS nxt,
         last_value(jt IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_type
  FROM r WINDOW w AS (PARTITION BY src, evidence_dir, field ORDER BY seq)),
l AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev < seq - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src, evidence_dir, field ORDER BY seq) AS island FROM marks),
born AS (SELECT * FROM l WHERE seq > 1 AND (prev IS NULL OR prev < seq - 1)),
gone AS (SELECT src, evidence_dir, next_id AS here, field, island, val, coalesce(jt, last_type) AS jt FROM l WHERE next_id IS NOT NULL AND (nxt IS NULL OR nxt > seq + 1)),
one AS (SELECT src, evidence_dir, here, val, any_value(field) AS was, any_value(island) AS was_island, any_value(jt) AS old_type FROM gone WHERE val IS NOT NULL GROUP BY src, evidence_dir, here, val HAVING count(*) = 1),
met AS (SELECT b.*, x.was, x.was_island, x.old_type FROM born b LEFT JOIN one x ON x.src = b.src AND x.evidence_dir = b.evidence_dir AND x.here = b.file_id AND x.val = b.val)
"""

_CHANGES = _LIVES + r"""
SELECT DISTINCT file_id, field AS field_name, CASE WHEN was IS NULL THEN 'added' ELSE 'renamed' END AS change_kind FROM met
UNION ALL SELECT DISTINCT here, field, 'removed' FROM gone WHERE (src, evidence_dir, here, field) NOT IN (SELECT (src, evidence_dir, file_id, was) FROM met WHERE was IS NOT NULL)
UNION ALL SELECT DISTINCT file_id, field, 'retyped' FROM met WHERE was IS NOT NULL AND jt <> old_type
UNION ALL SELECT DISTINCT file_id, field, 'retyped' FROM l WHERE prev = seq - 1 AND jt <> last_type
"""

_ALIASES = _LIVES + r""",
roots AS (
  SELECT DISTINCT src, evidence_dir, field, island, field AS canonical FROM l
  WHERE (src, evidence_dir, field, island) NOT IN (SELECT (src, evidence_dir, field, island) FROM met WHERE was IS NOT NULL)
  UNION ALL
  SELECT m.src, m.evidence_dir, m.field, m.island, r.canonical FROM roots r
  JOIN met m ON m.src = r.src AND m.evidence_dir = r.evidence_dir AND m.was = r.field AND m.was_island = r.island),
num AS (
  SELECT l.*, canonical, jt IS NULL AS absent, TRY_CAST(trim(regexp_replace(val, '([0-9]),([0-9]{3})', '\1\2', 'g')) AS DECIMAL(28, 9)) AS as_num
  FROM l JOIN roots r ON r.src = l.src AND r.evidence_dir = l.evidence_dir AND r.field = l.field AND r.island = l.island),
types AS (
  SELECT src, evidence_dir, canonical, CASE WHEN bool_or(jt IN ('array', 'object')) THEN 'json'
    WHEN bool_and(jt = 'boolean') THEN 'boolean' WHEN NOT bool_or(jt = 'boolean') AND (bool_or(jt IN ('integer', 'float')) OR bool_and(as_num IS NOT NULL) FILTER (jt = 'string')) THEN 'decimal'
    WHEN bool_or(jt IS NOT NULL) THEN 'string' END AS target_type
  FROM num GROUP BY ALL),
table_of AS (SELECT * FROM (VALUES ('a', 'source_sha256'), ('b', 'summaries')) t(src, source))
"""

#: Twin of p2_found, on which others build.
ELEMENT_ROWS = r"""
WITH f AS (
  SELECT 's' AS src, file_id, payload FROM summaries WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1
  UNION ALL SELECT 'c', file_id, payload FROM split_counters WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1),
n AS (
  SELECT src, file_id, payload, replace(t.fullkey, '"', '') AS k, t.fullkey, t.atom->>'$' AS v FROM f, json_tree(f.payload) t WHERE t.atom IS NOT NULL AND t.type <> 'NULL'),
m AS (
  SELECT *, coalesce(try_cast(nullif(regexp_extract(k, '\.(?:runs|lanes)\[(\d+)\]', 1), '') AS BIGINT), 0) AS run_no,
    regexp_extract(k, '^(\$.*\.arms\[\d+\]|\$\.arms\[\d+\])\.(?:cpu20_s|gpu_wall_s)', 1) AS arm_at,
    regexp_extract(k, '\.arms\.([^.\[]+)\.(?:cpu20_s|gpu_wall_s)', 1) AS arm_key,
    regexp_extract(k, '\.(inner|direct)\.calls_by_direction', 1) AS side,
    regexp_extract(k, '\.(cpu20_s|gpu_wall_s)(?:\[\d+\](?:\.s)?)?$', 1) AS timing,
    regexp_extract(k, '^(.*\.calls_by_direction\[\d+\])\.calls$', 1) AS obj
  FROM n)
SELECT DISTINCT file_id, run_no, CASE WHEN arm_at <> '' THEN json_extract_string(payload, arm_at || '.arm') ELSE arm_key END AS arm, timing AS field_name,
  coalesce(try_cast(nullif(regexp_extract(k, '\.(?:cpu20_s|gpu_wall_s)\[(\d+)\]', 1), '') AS BIGINT), 0) AS elem_no,
  round(v::DECIMAL(28, 10) * 1000000000)::BIGINT AS amount
FROM m WHERE src = 's' AND timing <> '' AND (arm_at <> '' OR arm_key <> '')
UNION ALL
SELECT DISTINCT file_id, run_no, side, 'calls_by_direction',
  CASE WHEN obj <> '' THEN json_extract_string(payload, obj || '.dir')::BIGINT ELSE regexp_extract(k, 'calls_by_direction[.\[](\d+)\]?$', 1)::BIGINT END,
  round(replace(v, ',', '')::DECIMAL(28, 10))::BIGINT
FROM m WHERE src = 'c' AND side <> '' AND (obj <> '' OR regexp_matches(k, 'calls_by_direction[.\[](\d+)\]?$'))
"""

_TREE = r"""
WITH RECURSIVE f AS (
  SELECT 'summaries' AS source, file_id, payload FROM summaries WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1
  UNION ALL SELECT 'split_counters', file_id, payload FROM split_counters WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1),
raw AS (
  SELECT source, file_id, t.id, t.parent, t.key, t.type, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN t.atom->>'$' END AS value,
         row_number() OVER (PARTITION BY source, file_id, t.parent ORDER BY t.id) - 1 AS ord
  FROM f, json_tree(f.payload) t),
n AS (
  SELECT source, file_id, id, parent, type, value, NULL::VARCHAR AS key, '' AS label, '' AS path, '' AS step, 0::BIGINT AS run_no, NULL::VARCHAR AS up_label, NULL::VARCHAR AS held
  FROM raw WHERE parent IS NULL
  UNION ALL
  SELECT c.source, c.file_id, c.id, c.parent, c.type, c.value, CASE WHEN p.type = 'OBJECT' THEN c.key END,
         CASE WHEN p.label = '' THEN '' ELSE p.label || '.' END || c.ord, CASE WHEN p.path = '' THEN '' ELSE p.path || '>' END || s.step, s.step,
         CASE WHEN p.step IN ('runs', 'lanes') AND p.type = 'ARRAY' THEN c.ord ELSE p.run_no END, p.label, p.up_label
  FROM raw c JOIN n p ON p.source = c.source AND p.file_id = c.file_id AND p.id = c.parent,
       LATERAL (SELECT CASE WHEN p.type = 'ARRAY' THEN '[]' WHEN p.step IN ('arms', 'calls_by_direction', 'log2_histogram') THEN '{}' ELSE c.key END AS step) s),
named AS (SELECT source, file_id, up_label AS at, step, value FROM n WHERE step IN ('arm', 'requests', 'run', 'lane', 'dir') AND value IS NOT NULL),
arm AS (
  SELECT a.source, a.file_id, a.label AS arm_id, CASE WHEN a.step IN ('inner', 'direct') THEN a.up_label ELSE a.held END AS parent_id, a.run_no,
         coalesce(a.key, x.value) AS arm, try_cast(q.value AS BIGINT) AS requests
  FROM n a LEFT JOIN named x ON x.step = 'arm' AND x.source = a.source AND x.file_id = a.file_id AND x.at = a.label
  LEFT JOIN named q ON q.step = 'requests' AND a.step NOT IN ('inner', 'direct') AND q.source = a.source AND q.file_id = a.file_id AND q.at = a.label
  WHERE a.type = 'OBJECT' AND (a.step IN ('inner', 'direct') OR regexp_matches(a.path, '(^|>)arms>(\{\}|\[\])$'))),
held AS (
  SELECT *, regexp_extract(path, '(?:^|>)arms>(?:\{\}|\[\])>(cpu20_s|gpu_wall_s)(?:>\[\](?:>s)?)?$', 1) AS timing,
         regexp_matches(path, '(^|>)(inner|direct)>calls_by_direction(>\[\](>calls)?|>\{\})?$') AS calls,
         length(path) - length(replace(path, '>', '')) + 1 AS depth FROM n WHERE value IS NOT NULL)
"""

#: Figures of the trace read source by source, as a CTE ``val`` (trace_id, task_name, submit_at, pct_cpu, field_name, amount) for twins.
TRACE_VALUES = r"""
WITH once AS (
  SELECT * FROM historical_trace WHERE trace_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY received_at DESC NULLS LAST) = 1),
long AS (
  SELECT trace_id, source_id, task_name, submit_at, pct_cpu, lower(coalesce(remark, '')) AS remark, unnest(['duration', 'realtime', 'peak_rss', 'rchar']) AS field_name,
         lower(trim(replace(unnest([duration, realtime, peak_rss, rchar]), chr(160), ' '))) AS t FROM once),
said AS (
  SELECT *, field_name IN ('duration', 'realtime') AS is_time, CASE WHEN field_name IN ('duration', 'realtime') THEN regexp_extract(remark, '(?:times|duration)[^;]*?(milliseconds|seconds|minutes)', 1)
    WHEN field_name = 'peak_rss' THEN regexp_extract(remark, '(?:memory|rss)[^;]*?(kib|mib|gib|kb|mb|gb)', 1) ELSE regexp_extract(remark, '(?:rchar|characters)[^;]*?(kib|mib|gib|kb|mb|gb)', 1) END AS word,
    CASE WHEN source_id = 5 THEN replace(t, ',', '.') ELSE replace(t, ',', '') END AS n
  FROM long WHERE t IS NOT NULL AND t NOT IN ('', '-', 'n/a')),
cut AS (
  SELECT *, CASE WHEN source_id NOT IN (1, 3, 6, 7, 8) OR NOT is_time THEN regexp_extract(n, '^([0-9.]+)', 1) END AS num, trim(regexp_extract(n, '^[0-9.]+ *([a-z]*)$', 1)) AS own FROM said),
unit AS (
  SELECT *, CASE WHEN own <> '' AND source_id = 6 THEN own || 'ib' WHEN own <> '' THEN own WHEN source_id = 12 THEN word
    ELSE split_part(CASE source_id WHEN 2 THEN 'ms ms b b' WHEN 3 THEN '- - kib kib' WHEN 4 THEN 's s b mib' WHEN 10 THEN 'min min mib gib' WHEN 11 THEN 'ds ds kb kb' END, ' ',
      list_position(['duration', 'realtime', 'peak_rss', 'rchar'], field_name)::INT) END AS u FROM cut),
val AS (
  SELECT trace_id, task_name, submit_at, pct_cpu, field_name, round(CASE
    WHEN is_time AND source_id IN (3, 6) THEN
      (coalesce(try_cast(nullif(regexp_extract(t, '^([0-9]+)-', 1), '') AS DECIMAL(28, 9)), 0) * 86400 + coalesce(try_cast(nullif(regexp_extract(t, '([0-9]+):[0-9]+:[0-9.]+$', 1), '') AS DECIMAL(28, 9)), 0) * 3600
       + regexp_extract(t, '([0-9]+):[0-9.]+$', 1)::DECIMAL(28, 9) * 60 + regexp_extract(t, ':([0-9.]+)$', 1)::DECIMAL(28, 9)) * 1000
    WHEN is_time AND source_id IN (1, 7, 8) THEN
      (coalesce(try_cast(nullif(regexp_extract(t, '([0-9.]+) *h', 1), '') AS DECIMAL(28, 9)), 0) * 3600 + coalesce(try_cast(nullif(regexp_extract(t, '([0-9.]+) *m', 1), '') AS DECIMAL(28, 9)), 0) * 60
       + coalesce(try_cast(nullif(regexp_extract(t, '([0-9.]+) *s', 1), '') AS DECIMAL(28, 9)), 0)) * 1000
    ELSE num::DECIMAL(28, 9) * CASE u WHEN 'ms' THEN 1 WHEN 'milliseconds' THEN 1 WHEN 'ds' THEN 100 WHEN 's' THEN 1000 WHEN 'seconds' THEN 1000 WHEN 'min' THEN 60000 WHEN 'minutes' THEN 60000
      WHEN 'b' THEN 1 WHEN 'kb' THEN 1000 WHEN 'mb' THEN 1000000 WHEN 'megabytes' THEN 1000000 WHEN 'gb' THEN 1000000000 WHEN 'gigabytes' THEN 1000000000
      WHEN 'kib' THEN 1024 WHEN 'mib' THEN 1048576 WHEN 'gib' THEN 1073741824 END END)::BIGINT AS amount FROM unit)
"""

ORACLES = {
    "p5_found": TRACE_VALUES + "SELECT trace_id, field_name, amount FROM val WHERE field_name <> 'realtime' AND amount IS NOT NULL",
    "p2_files": _TREE + "SELECT source, file_id, '' AS node_id, lower(type) AS kind FROM n WHERE parent IS NULL",
    "p2_runs": _TREE + r"""SELECT r.source, r.file_id, r.label AS node_id, r.held AS parent_id, r.run_no, x.value AS run_name
FROM n r LEFT JOIN named x ON x.step IN ('run', 'lane') AND x.source = r.source AND x.file_id = r.file_id AND x.at = r.label WHERE regexp_matches(r.path, '(^|>)(runs|lanes)>\[\]$')""",
    "p2_arms": _TREE + "SELECT * FROM arm",
    "p2_elements": _TREE + r"""SELECT h.source, h.file_id, h.run_no, a.arm, CASE WHEN timing <> '' THEN timing ELSE 'calls_by_direction' END AS field_name,
  coalesce(d.value::BIGINT, CASE WHEN h.step = '{}' THEN h.key::BIGINT END,
           try_cast(nullif(split_part(substr(h.label, length(a.arm_id) + 2), '.', 2), '') AS BIGINT), 0) AS elem_no,
  round(replace(h.value, ',', '')::DECIMAL(28, 10) * CASE WHEN timing <> '' THEN 1000000000 ELSE 1 END)::BIGINT AS amount, h.label AS node_id, a.arm_id
FROM held h JOIN arm a ON a.source = h.source AND a.file_id = h.file_id AND starts_with(h.label, a.arm_id || '.') AND (timing <> '') = (a.arm NOT IN ('inner', 'direct'))
LEFT JOIN named d ON d.step = 'dir' AND h.step = 'calls' AND d.source = h.source AND d.file_id = h.file_id AND d.at = h.up_label
WHERE (timing <> '' OR calls) AND h.type <> 'BOOLEAN'""",
    "p2_details": _TREE + "SELECT source, file_id, label AS node_id, up_label AS parent_id, run_no, path, key, value FROM held WHERE timing = '' AND NOT calls",
    "p1_found": _CHANGES,
    "p1_lifespans": _LIVES + r"""
SELECT source, evidence_dir AS producer, field, island, min(seq)::INT AS first_seq, max(seq)::INT AS last_seq, arg_min(file_id, seq) AS first_file_id, arg_max(file_id, seq) AS last_file_id,
  count(*) AS n_files, coalesce(array_to_string(list_sort(list(DISTINCT jt) FILTER (jt IS NOT NULL)), ','), '') AS types
FROM l JOIN (VALUES ('a', 'source_sha256'), ('b', 'summaries')) t(src, source) USING (src) GROUP BY ALL""",
    "p1_aliases": _ALIASES + "SELECT DISTINCT source, n.evidence_dir AS producer, field, island, canonical, target_type FROM num n JOIN types USING (src, evidence_dir, canonical) JOIN table_of USING (src)",
    "p1_failed_casts": _ALIASES + """SELECT source, n.evidence_dir AS producer, file_id, canonical AS field_name, field AS source_name, jt AS json_type, target_type, val AS value_text
FROM num n JOIN types USING (src, evidence_dir, canonical) JOIN table_of USING (src) WHERE target_type = 'decimal' AND val IS NOT NULL AND as_num IS NULL""",
    "p2_found": ELEMENT_ROWS,
    "p3_found": _ONCE + "SELECT tid, pos FROM places WHERE n_mapped > 0 AND n_mapped >= 0.01 * (SELECT sum(n_mapped) FROM places)",
    "p3_places": _ONCE + "SELECT * FROM places",
}
