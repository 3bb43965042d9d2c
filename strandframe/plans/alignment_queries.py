"""Queries over alignments, references and exons, and their DuckDB twins.

The table has no base qualities; where records are ranked by score, the record's length in
bytes stands for it. Each record counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar, flags
from strandframe.operators import annotation, grouping, intervals, reports
from strandframe.session import load, written


PLACED = ("flag", "tid", "pos", "cigar")
JUDGED = (*PLACED, "qname", "body_len")


def _aln(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each record once, with no more columns than a query reads: the others are never scanned or sent."""
    return grouping.latest(load(spark, d, "alignments").select("rec_idx", "loaded_at", *columns), "rec_idx", "loaded_at")


def _dups(aln: DataFrame) -> DataFrame:
    return grouping.duplicates(aln, F.col("body_len"))


_MADE: dict[tuple, DataFrame] = {}


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Records with the computed duplicate mark: one table for all reports, made once per session and state of the input.

    It is made again where the input has changed or its files are no longer in the shared folder.
    """
    key = (spark.sparkContext.applicationId, d, _version(spark, f"{d}/alignments.parquet"))
    if key not in _MADE or not _present(_MADE[key]):
        aln = written(_aln(spark, d, *JUDGED, "mapq", "mate_tid", "mate_pos", "nh"))
        _MADE.clear()
        _MADE[key] = written(reports.with_duplicates(aln, _dups(aln)))
    return _MADE[key]


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a file or folder was last changed, and its size."""
    at, files = _filesystem(spark, path)
    return files.getFileStatus(at).getModificationTime(), files.getContentSummary(at).getLength()


def _present(table: DataFrame) -> bool:
    """Whether all files of a written table are still there."""
    paths = [_filesystem(table.sparkSession, p) for p in table.inputFiles()]
    return bool(paths) and all(files.exists(at) for at, files in paths)


def _genes(spark: SparkSession, d: str, any_case: bool = False) -> DataFrame:
    return annotation.gene_exons(load(spark, d, "gtf_exons"), load(spark, d, "ref_seqs"), any_case)


def _spans(spark: SparkSession, d: str, rule) -> DataFrame:
    spans = _aln(spark, d, "pos", "cigar").select("rec_idx", F.inline(rule(F.col("pos"), cigar.ops(F.col("cigar")))))
    return spans.where("start IS NOT NULL")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions asked for: every gene's span."""
    return annotation.transcripts(_genes(spark, d)).select(F.col("gene_id").alias("region_id"), "tid", F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    o = cigar.ops(F.col("cigar"))
    return _aln(spark, d, "cigar").select(
        "rec_idx", cigar.leading_clip(o).alias("lead_clip"), cigar.trailing_clip(o).alias("trail_clip"), cigar.reference_length(o).alias("ref_length"),
        cigar.query_length(o).alias("query_length"), cigar.total(o, ("N",)).alias("intron_length"),
    )


def _bins(spark: SparkSession, d: str) -> DataFrame:
    placed = _aln(spark, d, *PLACED).where("tid >= 0 AND pos >= 0")
    end = F.col("pos") + F.when(flags.lacks(flags.UNMAPPED), F.greatest(cigar.reference_length(cigar.ops(F.col("cigar"))), F.lit(1))).otherwise(1)
    return placed.groupBy("tid", flags.reg2bin(F.col("pos"), end).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _flag_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _dups(_aln(spark, d, *JUDGED))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    aln = _aln(spark, d, *JUDGED)
    return reports.duplication_metrics(aln, _dups(aln))


def _mates(spark: SparkSession, d: str) -> DataFrame:
    kept = _aln(spark, d, "qname", "flag").where(flags.lacks(flags.NOT_EXAMINED))
    return grouping.mate_pairs(kept).select("qname", F.col("a.rec_idx").alias("rec_a"), F.col("b.rec_idx").alias("rec_b"))


def _rank(spark: SparkSession, d: str) -> DataFrame:
    return grouping.global_rank(_aln(spark, d, "tid", "pos").drop("loaded_at"), ["tid", "pos", "rec_idx"], "coord_rank")


def _junctions(spark: SparkSession, d: str) -> DataFrame:
    events = reports.junction_events(_marked(spark, d))
    return reports.junctions(events, _genes(spark, d, True))


def _junction_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.junction_totals(reports.junction_events(_marked(spark, d)), _genes(spark, d, True))


def chain(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every report of one run, all from the one marked table: by name, to be written or joined on."""
    marked, refs, genes, any_case = _marked(spark, d), load(spark, d, "ref_seqs"), _genes(spark, d), _genes(spark, d, True)
    events = reports.junction_events(marked)
    return {
        "flagstat": reports.flagstat(marked), "flagstat_post": reports.flagstat(marked, computed=True), "idxstats": reports.idxstats(marked, refs),
        "bam_stat": reports.bam_stat(marked), "coverage": reports.coverage(marked, refs), "gene_counts": reports.gene_counts(marked, genes),
        "dup_matrix": reports.duplication_matrix(marked, genes), "read_distribution": reports.read_distribution(marked, any_case),
        "junctions": reports.junctions(events, any_case), "junction_totals": reports.junction_totals(events, any_case),
        "junction_saturation": reports.junction_saturation(marked, any_case), "infer_experiment": reports.infer_experiment(marked, any_case),
        "inner_distance": reports.inner_distance(marked, any_case), "pos_dup_hist": reports.position_duplication(marked), "aln_qc": reports.alignment_qc(marked, genes),
    }


def write_chain(spark: SparkSession, d: str, out: str) -> dict[str, str]:
    """Writes every report of :func:`chain` as Parquet under ``out``: the folder of each."""
    paths = {}
    for name, report in chain(spark, d).items():
        paths[name] = f"{out}/{name}"
        report.write.mode("overwrite").parquet(paths[name])
    return paths


def _chain_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain in one table: report and number of its rows."""
    rows = None
    for name, report in chain(spark, d).items():
        one = report.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


QUERIES = {
    "chain": _chain_rows,
    "coordinate_rank": _rank,
    "flagstat": lambda s, d: reports.flagstat(_aln(s, d, "flag", "tid", "mate_tid", "mapq")),
    "flagstat_post": lambda s, d: reports.flagstat(_marked(s, d), computed=True),
    "idxstats": lambda s, d: reports.idxstats(_aln(s, d, "flag", "tid"), load(s, d, "ref_seqs")),
    "bam_stat": lambda s, d: reports.bam_stat(_marked(s, d)),
    "mate_pairs": _mates,
    "markdup_flags": _flag_duplicates,
    "markdup_metrics": _metrics,
    "cigar_shape": _shapes,
    "blocks_split": lambda s, d: _spans(s, d, cigar.coverage_blocks),
    "blocks_rseqc": lambda s, d: _spans(s, d, cigar.qc_blocks),
    "introns": lambda s, d: _spans(s, d, cigar.introns),
    "coverage_sweep": lambda s, d: reports.coverage(_aln(s, d, *PLACED), load(s, d, "ref_seqs")),
    "reg2bin": _bins,
    "region_query": lambda s, d: reports.region_query(_aln(s, d, *PLACED), _regions(s, d)),
    "gene_merge": lambda s, d: annotation.merged_exons(_genes(s, d)),
    "gene_length": lambda s, d: annotation.gene_lengths(_genes(s, d)),
    "gene_hits": lambda s, d: reports.gene_hits(_aln(s, d, *PLACED).where(flags.lacks(flags.NOT_EXAMINED)), _genes(s, d)).select("rec_idx", F.explode("genes").alias("gene_id")),
    "gene_counts": lambda s, d: reports.gene_counts(_aln(s, d, *PLACED, "qname", "nh"), _genes(s, d)),
    "dup_matrix": lambda s, d: reports.duplication_matrix(_marked(s, d), _genes(s, d)),
    "interval_subtract": lambda s, d: annotation.regions(_genes(s, d, True)),
    "region_bases": lambda s, d: intervals.covered(annotation.regions(_genes(s, d, True)), ["class"]),
    "read_distribution": lambda s, d: reports.read_distribution(_marked(s, d), _genes(s, d, True)),
    "junction_annotation": _junctions,
    "junction_totals": _junction_totals,
    "junction_saturation": lambda s, d: reports.junction_saturation(_marked(s, d), _genes(s, d, True)),
    "infer_experiment": lambda s, d: reports.infer_experiment(_marked(s, d), _genes(s, d, True)),
    "inner_distance": lambda s, d: reports.inner_distance(_marked(s, d), _genes(s, d, True)),
    "pos_dup_hist": lambda s, d: reports.position_duplication(_aln(s, d, *PLACED, "mapq")),
    "seq_dup_hist": lambda s, d: grouping.two_level_histogram(load(s, d, "documents"), ["text"]),
    "aln_qc": lambda s, d: reports.alignment_qc(_aln(s, d, *PLACED, "qname", "nh"), _genes(s, d)),
}

# Pieces of the SQL twins.
_ALN = """
aln AS (
  SELECT * FROM alignments WHERE rec_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rec_idx ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_OPS = _ALN + """,
parsed AS (
  SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 1) AS ls, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 2) AS os FROM aln),
ops AS (SELECT rec_idx, pos::BIGINT AS pos, unnest(range(1, len(ls) + 1)) AS i, unnest(ls)::BIGINT AS l, unnest(os) AS o FROM parsed),
walk AS (
  SELECT *, pos + coalesce(sum(CASE WHEN o IN ('M','D','N','=','X') THEN l ELSE 0 END) OVER w, 0)::BIGINT AS ref_at,
         pos + coalesce(sum(CASE WHEN o IN ('M','D','N','S') THEN l ELSE 0 END) OVER w, 0)::BIGINT AS qc_at,
         sum(CASE WHEN o IN ('S','H') THEN 0 ELSE 1 END) OVER (PARTITION BY rec_idx ORDER BY i) AS solid,
         sum(CASE WHEN o IN ('S','H') THEN 0 ELSE 1 END) OVER (PARTITION BY rec_idx ORDER BY i DESC) AS solid_back
  FROM ops WINDOW w AS (PARTITION BY rec_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shape AS (
  SELECT a.rec_idx, coalesce(sum(l) FILTER (solid = 0), 0)::BIGINT AS lead_clip, coalesce(sum(l) FILTER (solid_back = 0), 0)::BIGINT AS trail_clip,
         coalesce(sum(l) FILTER (o IN ('M','D','N','=','X')), 0)::BIGINT AS ref_length, coalesce(sum(l) FILTER (o IN ('M','I','=','X')), 0)::BIGINT AS query_length,
         coalesce(sum(l) FILTER (o = 'N'), 0)::BIGINT AS intron_length, coalesce(sum(l) FILTER (o IN ('M','I','S','=','X')), 0)::BIGINT AS l_seq
  FROM aln a LEFT JOIN walk w ON a.rec_idx = w.rec_idx GROUP BY a.rec_idx),
cov AS (SELECT rec_idx, ref_at AS s, ref_at + l AS e FROM walk WHERE o IN ('M','=','X')),
qcb AS (SELECT rec_idx, qc_at AS s, qc_at + l AS e FROM walk WHERE o = 'M'),
gap AS (SELECT rec_idx, i, ref_at AS s, ref_at + l AS e FROM walk WHERE o = 'N')"""
_DUP = _OPS + """,
ends AS (
  SELECT a.rec_idx, qname, flag, tid, pos, body_len AS score, flag & 16 <> 0 AS rev,
         CASE WHEN flag & 16 <> 0 THEN pos + ref_length - 1 + trail_clip ELSE pos - lead_clip END AS e5
  FROM aln a JOIN shape USING (rec_idx) WHERE flag & 2308 = 0),
firsts AS (
  SELECT qname, min(rec_idx) FILTER (flag & 64 <> 0) AS ra, min(rec_idx) FILTER (flag & 128 <> 0) AS rb FROM ends WHERE qname IS NOT NULL GROUP BY qname),
couples AS (
  SELECT f.qname, ra, rb, a.score + b.score AS score,
         least(struct_pack(t := a.tid, p := a.e5, r := a.rev), struct_pack(t := b.tid, p := b.e5, r := b.rev)) AS lo,
         greatest(struct_pack(t := a.tid, p := a.e5, r := a.rev), struct_pack(t := b.tid, p := b.e5, r := b.rev)) AS hi,
         least(struct_pack(t := a.tid, p := a.pos, i := ra), struct_pack(t := b.tid, p := b.pos, i := rb)) AS place
  FROM firsts f JOIN ends a ON a.rec_idx = ra JOIN ends b ON b.rec_idx = rb WHERE a.flag & 9 = 1 AND b.flag & 9 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY score DESC, place, ra, rb) > 1 AS is_duplicate FROM couples),
members AS (SELECT ra AS rec_idx, is_duplicate FROM ranked UNION SELECT rb, is_duplicate FROM ranked),
pair_ends AS (SELECT lo AS k FROM couples UNION SELECT hi FROM couples),
alone AS (
  SELECT rec_idx, struct_pack(t := tid, p := e5, r := rev) AS k, score, tid, pos FROM ends WHERE rec_idx NOT IN (SELECT rec_idx FROM members)),
judged AS (
  SELECT rec_idx, TRUE AS is_pair, is_duplicate FROM members UNION ALL
  SELECT rec_idx, FALSE, k IN (SELECT k FROM pair_ends) OR row_number() OVER (PARTITION BY k ORDER BY score DESC, tid, pos, rec_idx) > 1 FROM alone),
marked AS (SELECT a.*, coalesce(j.is_duplicate, FALSE) AS is_dup FROM aln a LEFT JOIN judged j USING (rec_idx))"""


def _gene_sql(any_case: bool) -> str:
    name = "upper" if any_case else ""
    return f""",
placed AS (
  SELECT gene_id, r.tid, strand FROM (
    SELECT gene_id, first(chrom ORDER BY ord_no) AS chrom, arg_min(struct_pack(s := strand), ord_no).s AS strand
    FROM gtf_exons WHERE feature = 'exon' AND gene_id IS NOT NULL GROUP BY gene_id) f
  JOIN ref_seqs r ON {name}(f.chrom) = {name}(r.ref_name)),
gx AS (SELECT gene_id, tid, placed.strand, exon_start AS s, exon_end AS e FROM gtf_exons JOIN placed USING (gene_id) WHERE feature = 'exon'),
gi AS (
  SELECT *, sum(fresh) OVER (PARTITION BY gene_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM gx WHERE s < e)),
gm AS (SELECT gene_id, any_value(tid) AS tid, min(s) AS s, max(e) AS e FROM gi GROUP BY gene_id, island),
glen AS (SELECT gene_id, sum(e - s)::BIGINT AS length FROM gm GROUP BY gene_id),
tx AS (SELECT gene_id, tid, any_value(strand) AS strand, min(s) AS s, max(e) AS e, min(s) + 10 AS ts, max(e) - 10 AS te FROM gx GROUP BY gene_id, tid),
mi AS (SELECT * FROM (SELECT gene_id, tid, e AS s, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS e FROM gm) WHERE e IS NOT NULL)"""


_GENES, _GENES_ANY = _gene_sql(False), _gene_sql(True)
_HITS = """,
shapes AS (SELECT DISTINCT tid, pos, cigar, min(rec_idx) AS rec_idx FROM aln GROUP BY tid, pos, cigar),
shape_hits AS (
  SELECT DISTINCT a.tid, a.pos, a.cigar, g.gene_id FROM shapes a JOIN cov c USING (rec_idx) JOIN gm g ON g.tid = a.tid AND g.s < c.e AND g.e > c.s),
hits AS (SELECT a.rec_idx, list_sort(list(h.gene_id)) AS genes FROM aln a JOIN shape_hits h USING (tid, pos, cigar) GROUP BY a.rec_idx)"""
_VOTE = """CASE WHEN len({a}) = 0 THEN CASE WHEN len({b}) = 1 THEN {b}[1] END WHEN len({b}) = 0 THEN CASE WHEN len({a}) = 1 THEN {a}[1] END
       WHEN len(list_intersect({a}, {b})) = 1 THEN list_intersect({a}, {b})[1] END"""
_REGIONS = """,
part AS (SELECT m.tid, m.s, m.e, t.ts, t.te, coalesce(t.strand = '+', FALSE) AS plus, t.s AS xs, t.e AS xe FROM gm m JOIN tx t USING (gene_id)),
win AS (SELECT tid, s, e, coalesce(strand = '+', FALSE) AS plus, unnest([1, 5, 10]) AS kb FROM tx),
raw AS (
  SELECT 'cds' AS class, tid, greatest(s, ts) AS s, least(e, te) AS e FROM part
  UNION ALL SELECT CASE WHEN (least(e, ts) <= ts) = plus THEN 'utr5' ELSE 'utr3' END, tid, s, least(e, ts) FROM part
  UNION ALL SELECT CASE WHEN (e <= ts) = plus THEN 'utr5' ELSE 'utr3' END, tid, greatest(s, te), e FROM part
  UNION ALL SELECT 'intron', tid, s, e FROM mi
  UNION ALL SELECT CASE WHEN plus THEN 'up' ELSE 'down' END || kb, tid, greatest(s - kb * 1000, 0), s FROM win
  UNION ALL SELECT CASE WHEN plus THEN 'down' ELSE 'up' END || kb, tid, e, e + kb * 1000 FROM win),
solid AS (SELECT * FROM raw WHERE s < e),
rules AS (
  SELECT * FROM (VALUES ('cds', 'utr5'), ('cds', 'utr3'), ('cds', 'intron'), ('utr5', 'intron'), ('utr3', 'intron')) t(strong, weak)
  UNION ALL SELECT strong, weak FROM (VALUES ('cds'), ('utr5'), ('utr3'), ('intron')) a(strong), (VALUES ('up1'), ('up5'), ('up10'), ('down1'), ('down5'), ('down10')) b(weak)),
marks AS (
  SELECT class, tid, s AS x, 1 AS a, 0 AS b FROM solid UNION ALL SELECT class, tid, e, -1, 0 FROM solid
  UNION ALL SELECT weak, tid, s, 0, 1 FROM solid JOIN rules ON class = strong UNION ALL SELECT weak, tid, e, 0, -1 FROM solid JOIN rules ON class = strong),
sweep AS (
  SELECT class, tid, x AS s, lead(x) OVER w AS e, sum(a) OVER (w ROWS UNBOUNDED PRECEDING) AS na, sum(b) OVER (w ROWS UNBOUNDED PRECEDING) AS nb
  FROM (SELECT class, tid, x, sum(a) AS a, sum(b) AS b FROM marks GROUP BY ALL) WINDOW w AS (PARTITION BY class, tid ORDER BY x)),
pieces AS (SELECT class, tid, s, e FROM sweep WHERE na > 0 AND nb = 0 AND e IS NOT NULL),
joined AS (
  SELECT *, sum(fresh) OVER (PARTITION BY class, tid ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY class, tid ORDER BY s) THEN 0 ELSE 1 END AS fresh FROM pieces)),
region AS (SELECT class, tid, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM joined GROUP BY class, tid, island)"""
_FLAGSTAT = """
SELECT count(*) AS total, count(*) FILTER (flag & 2304 = 0) AS "primary", count(*) FILTER (flag & 256 <> 0) AS secondary,
  count(*) FILTER (flag & 2048 <> 0) AS supplementary, count(*) FILTER ({dup}) AS duplicates, count(*) FILTER (({dup}) AND flag & 2304 = 0) AS primary_duplicates,
  count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 2308 = 0) AS primary_mapped, count(*) FILTER (flag & 2305 = 1) AS paired,
  count(*) FILTER (flag & 2305 = 1 AND flag & 64 <> 0) AS read1, count(*) FILTER (flag & 2305 = 1 AND flag & 128 <> 0) AS read2,
  count(*) FILTER (flag & 2309 = 1 AND flag & 2 <> 0) AS proper, count(*) FILTER (flag & 2317 = 1) AS both_mapped,
  count(*) FILTER (flag & 2317 = 9) AS singletons, count(*) FILTER (flag & 2317 = 1 AND tid IS DISTINCT FROM mate_tid) AS different_chr,
  count(*) FILTER (flag & 2317 = 1 AND tid IS DISTINCT FROM mate_tid AND mapq >= 5) AS different_chr_mapq5
FROM {rows}"""
_JUNCTIONS = """,
jev AS (
  SELECT m.tid, g.s, g.e, count(*) AS n, min(struct_pack(p := m.pos, r := m.rec_idx, i := g.i)).r AS first_rec_idx
  FROM marked m JOIN gap g USING (rec_idx) WHERE m.flag & 772 = 0 AND NOT m.is_dup AND m.mapq >= 30 GROUP BY m.tid, g.s, g.e),
jun AS (
  SELECT tid, s AS start, e AS "end", n AS n_reads,
    CASE WHEN a AND b THEN 'annotated' WHEN a OR b THEN 'partial_novel' ELSE 'complete_novel' END AS kind, c AS known_pair, first_rec_idx
  FROM (SELECT *, (tid, s) IN (SELECT (tid, s) FROM mi) AS a, (tid, e) IN (SELECT (tid, e) FROM mi) AS b, (tid, s, e) IN (SELECT (tid, s, e) FROM mi) AS c
        FROM jev WHERE e - s >= 50))"""

ORACLES = {
    "coordinate_rank": f"WITH {_ALN} SELECT rec_idx, tid, pos, row_number() OVER (ORDER BY tid NULLS FIRST, pos NULLS FIRST, rec_idx) AS coord_rank FROM aln",
    "flagstat": f"WITH {_ALN} " + _FLAGSTAT.format(dup="flag & 1024 <> 0", rows="aln"),
    "flagstat_post": f"WITH {_DUP} " + _FLAGSTAT.format(dup="flag & 1024 <> 0 OR is_dup", rows="marked"),
    "idxstats": f"""WITH {_ALN}
SELECT r.tid, ref_name, ref_length::BIGINT AS ref_length, count(rec_idx) FILTER (flag & 4 = 0) AS mapped, count(rec_idx) FILTER (flag & 4 <> 0) AS unmapped
FROM ref_seqs r LEFT JOIN aln a ON a.tid = r.tid GROUP BY r.tid, ref_name, ref_length
UNION ALL SELECT NULL, '*', 0, 0, count(*) FILTER (tid IS NULL OR tid < 0) FROM aln""",
    "bam_stat": f"""WITH {_DUP}, c AS (SELECT *, CASE WHEN flag & 512 <> 0 THEN 'q' WHEN flag & 1024 <> 0 OR is_dup THEN 'd' WHEN flag & 256 <> 0 THEN 'n'
  WHEN flag & 4 <> 0 THEN 'u' WHEN mapq < 30 THEN 'l' ELSE 'x' END AS k FROM marked)
SELECT count(*) AS total, count(*) FILTER (k = 'q') AS qc_fail, count(*) FILTER (k = 'd') AS duplicate, count(*) FILTER (k = 'n') AS non_primary,
  count(*) FILTER (k = 'u') AS unmapped, count(*) FILTER (k = 'l') AS low_mapq, count(*) FILTER (k = 'x') AS "unique",
  count(*) FILTER (k = 'x' AND flag & 64 <> 0) AS read1, count(*) FILTER (k = 'x' AND flag & 128 <> 0) AS read2,
  count(*) FILTER (k = 'x' AND flag & 16 = 0) AS plus, count(*) FILTER (k = 'x' AND flag & 16 <> 0) AS minus,
  count(*) FILTER (k = 'x' AND contains(cigar, 'N')) AS splice, count(*) FILTER (k = 'x' AND NOT contains(cigar, 'N')) AS non_splice,
  count(*) FILTER (k = 'x' AND flag & 2 <> 0) AS proper, count(*) FILTER (k = 'x' AND flag & 2 <> 0 AND tid IS DISTINCT FROM mate_tid) AS proper_different FROM c""",
    "mate_pairs": f"WITH {_DUP} SELECT qname, ra AS rec_a, rb AS rec_b FROM couples",
    "markdup_flags": f"WITH {_DUP} SELECT rec_idx, is_pair, is_duplicate FROM judged",
    "markdup_metrics": f"""WITH {_DUP}, u AS (SELECT count(*) AS n, count(*) FILTER (is_duplicate) AS d FROM judged WHERE NOT is_pair),
p AS (SELECT count(*) AS n, count(*) FILTER (is_duplicate) AS d FROM ranked)
SELECT u.n AS unpaired_examined, p.n AS pairs_examined, u.d AS unpaired_duplicates, p.d AS pair_duplicates,
  (SELECT count(*) FROM aln WHERE flag & 2304 <> 0) AS secondary_or_supplementary, (SELECT count(*) FROM aln WHERE flag & 2304 = 0 AND flag & 4 <> 0) AS unmapped,
  round(CASE WHEN u.n + 2 * p.n = 0 THEN 0 ELSE (u.d + 2 * p.d) / (u.n + 2 * p.n) END, 6) AS percent_duplication FROM u, p""",
    "cigar_shape": f"WITH {_OPS} SELECT rec_idx, lead_clip, trail_clip, ref_length, query_length, intron_length FROM shape",
    "blocks_split": f'WITH {_OPS} SELECT rec_idx, s AS start, e AS "end" FROM cov WHERE s IS NOT NULL',
    "blocks_rseqc": f'WITH {_OPS} SELECT rec_idx, s AS start, e AS "end" FROM qcb WHERE s IS NOT NULL',
    "introns": f'WITH {_OPS} SELECT rec_idx, s AS start, e AS "end" FROM gap WHERE s IS NOT NULL',
    "coverage_sweep": f"""WITH {_OPS}, b AS (
  SELECT a.tid, greatest(c.s, 0) AS s, least(c.e, r.ref_length) AS e FROM aln a JOIN cov c USING (rec_idx) JOIN ref_seqs r ON r.tid = a.tid WHERE a.flag & 4 = 0),
d AS (SELECT tid, x, sum(v) AS v FROM (SELECT tid, s AS x, 1 AS v FROM b WHERE s < e UNION ALL SELECT tid, e, -1 FROM b WHERE s < e) GROUP BY tid, x HAVING sum(v) <> 0)
SELECT tid, x::BIGINT AS start, n::BIGINT AS "end", depth::BIGINT AS depth FROM (
  SELECT tid, x, lead(x) OVER (PARTITION BY tid ORDER BY x) AS n, sum(v) OVER (PARTITION BY tid ORDER BY x) AS depth FROM d) WHERE depth > 0""",
    "reg2bin": f"""WITH {_OPS}, p AS (
  SELECT a.tid, a.pos::BIGINT AS b, a.pos + CASE WHEN a.flag & 4 = 0 THEN greatest(s.ref_length, 1) ELSE 1 END - 1 AS e FROM aln a JOIN shape s USING (rec_idx) WHERE a.tid >= 0 AND a.pos >= 0)
SELECT tid, (CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20)
  WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = e >> 26 THEN 1 + (b >> 26) ELSE 0 END)::INT AS bin, count(*) AS n FROM p GROUP BY ALL""",
    "region_query": f"""WITH {_OPS}{_GENES}, p AS (
  SELECT a.rec_idx, a.tid, a.pos AS s, a.pos + CASE WHEN a.flag & 4 = 0 THEN greatest(h.ref_length, 1) ELSE 1 END AS e FROM aln a JOIN shape h USING (rec_idx) WHERE a.tid >= 0 AND a.pos >= 0)
SELECT gene_id AS region_id, rec_idx FROM p JOIN tx ON tx.tid = p.tid AND tx.s < p.e AND tx.e > p.s""",
    "gene_merge": f'WITH {_ALN}{_GENES} SELECT gene_id, tid, s AS start, e AS "end" FROM gm',
    "gene_length": f"WITH {_ALN}{_GENES} SELECT * FROM glen",
    "gene_hits": f"WITH {_OPS}{_GENES}{_HITS} SELECT rec_idx, unnest(genes) AS gene_id FROM hits JOIN aln USING (rec_idx) WHERE flag & 2308 = 0",
    "gene_counts": f"""WITH {_OPS}{_GENES}{_HITS}, f AS (
  SELECT qname, count(*) FILTER (flag & 64 <> 0) AS n1, count(*) FILTER (flag & 128 <> 0) AS n2, max(coalesce(nh, 1)) AS nh,
         coalesce(max(genes) FILTER (flag & 64 <> 0), []) AS a, coalesce(max(genes) FILTER (flag & 128 <> 0), []) AS b
  FROM aln LEFT JOIN hits USING (rec_idx) WHERE flag & 2308 = 0 AND (flag & 64 <> 0) <> (flag & 128 <> 0) GROUP BY qname),
v AS (SELECT {_VOTE.format(a='a', b='b')} AS gene_id FROM f WHERE n1 <= 1 AND n2 <= 1 AND nh <= 1)
SELECT g.gene_id, g.length, count(v.gene_id) AS n_fragments FROM glen g LEFT JOIN v USING (gene_id) GROUP BY g.gene_id, g.length""",
    "dup_matrix": f"""WITH {_DUP}{_GENES}{_HITS}, r AS (
  SELECT qname, rec_idx, mate_pos, coalesce(genes, []) AS genes, flag & 64 <> 0 AS one, m.mode FROM marked LEFT JOIN hits USING (rec_idx), (VALUES (0), (1), (2), (3)) m(mode)
  WHERE flag & 2052 = 0 AND (flag & 64 <> 0) <> (flag & 128 <> 0) AND (m.mode & 1 = 0 OR NOT is_dup) AND (m.mode & 2 = 0 OR coalesce(nh, 1) <= 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY qname, mode, one ORDER BY mate_pos NULLS FIRST, rec_idx) AS i FROM r),
f AS (SELECT mode, coalesce(max(genes) FILTER (one), []) AS a, coalesce(max(genes) FILTER (NOT one), []) AS b FROM o GROUP BY qname, mode, i),
v AS (SELECT mode, {_VOTE.format(a='a', b='b')} AS gene_id FROM f),
n AS (SELECT g.gene_id, g.length, count(v.mode) FILTER (mode = 0) AS n0, count(v.mode) FILTER (mode = 1) AS n1, count(v.mode) FILTER (mode = 2) AS n2, count(v.mode) FILTER (mode = 3) AS n3,
  (SELECT count(*) FROM f WHERE mode = 0) AS t FROM glen g LEFT JOIN v USING (gene_id) GROUP BY g.gene_id, g.length)
SELECT gene_id, length, n0 AS all_counts_multi, n1 AS filtered_counts_multi, round((n0 - n1) / nullif(n0, 0), 6) AS dup_rate_multi, n0 - n1 AS dups_per_id_multi,
  round(n0 * 1000.0::DOUBLE / length, 6) AS rpk_multi, round(CASE WHEN n0 = 0 OR t = 0 THEN 0 ELSE n0 * 1000.0::DOUBLE / length * 1e6 / t END, 6) AS rpkm_multi,
  n2 AS all_counts, n3 AS filtered_counts, round((n2 - n3) / nullif(n2, 0), 6) AS dup_rate, n2 - n3 AS dups_per_id,
  round(n2 * 1000.0::DOUBLE / length, 6) AS rpk, round(CASE WHEN n2 = 0 OR t = 0 THEN 0 ELSE n2 * 1000.0::DOUBLE / length * 1e6 / t END, 6) AS rpkm FROM n""",
    "interval_subtract": f'WITH {_ALN}{_GENES_ANY}{_REGIONS} SELECT class, tid, s AS start, e AS "end" FROM region',
    "region_bases": f"WITH {_ALN}{_GENES_ANY}{_REGIONS} SELECT class, sum(e - s)::BIGINT AS bases FROM region GROUP BY class",
    "read_distribution": f"""WITH {_DUP}{_GENES_ANY}{_REGIONS}, kept AS (SELECT * FROM marked WHERE flag & 772 = 0 AND NOT is_dup),
tags AS (SELECT k.tid, b.s + (b.e - b.s) // 2 AS p, count(*) AS n FROM kept k JOIN qcb b USING (rec_idx) GROUP BY ALL),
w AS (SELECT t.tid, t.p, any_value(t.n) AS n, coalesce(list(DISTINCT r.class) FILTER (r.class IS NOT NULL), []) AS c FROM tags t LEFT JOIN region r ON r.tid = t.tid AND r.s < t.p AND t.p < r.e GROUP BY t.tid, t.p),
x AS (SELECT n, CASE WHEN list_contains(c, 'cds') THEN ['cds'] WHEN list_contains(c, 'utr5') AND NOT list_contains(c, 'utr3') THEN ['utr5']
  WHEN list_contains(c, 'utr3') AND NOT list_contains(c, 'utr5') THEN ['utr3'] WHEN list_contains(c, 'utr5') THEN [] WHEN list_contains(c, 'intron') THEN ['intron']
  WHEN list_contains(c, 'up10') AND list_contains(c, 'down10') THEN [] WHEN list_contains(c, 'up1') THEN ['up1', 'up5', 'up10'] WHEN list_contains(c, 'up5') THEN ['up5', 'up10']
  WHEN list_contains(c, 'up10') THEN ['up10'] WHEN list_contains(c, 'down1') THEN ['down1', 'down5', 'down10'] WHEN list_contains(c, 'down5') THEN ['down5', 'down10']
  WHEN list_contains(c, 'down10') THEN ['down10'] ELSE [] END AS k FROM w),
y AS (SELECT class, sum(n) AS tags FROM (SELECT unnest(k) AS class, n FROM x) GROUP BY class), z AS (SELECT class, sum(e - s) AS bases FROM region GROUP BY class)
SELECT class, coalesce(bases, 0)::BIGINT AS bases, coalesce(tags, 0)::BIGINT AS tags, round(coalesce(tags, 0) * 1000.0::DOUBLE / (coalesce(bases, 0) + 1), 6) AS tags_per_kb
FROM (SELECT unnest(['cds','utr5','utr3','intron','up1','up5','up10','down1','down5','down10']) AS class) LEFT JOIN z USING (class) LEFT JOIN y USING (class)
UNION ALL SELECT 'total_reads', NULL, (SELECT count(*) FROM kept), NULL UNION ALL SELECT 'total_tags', NULL, (SELECT sum(n) FROM x)::BIGINT, NULL
UNION ALL SELECT 'assigned_tags', NULL, (SELECT coalesce(sum(n), 0) FROM x WHERE len(k) > 0)::BIGINT, NULL""",
    "junction_annotation": f"WITH {_DUP}{_GENES_ANY}{_JUNCTIONS} SELECT * FROM jun",
    "junction_totals": f"""WITH {_DUP}{_GENES_ANY}{_JUNCTIONS} SELECT kind, sum(n_reads)::BIGINT AS n_events, count(*) AS n_junctions FROM jun GROUP BY kind
UNION ALL SELECT 'filtered', coalesce(sum(n), 0)::BIGINT, 0 FROM jev WHERE e - s < 50""",
    "junction_saturation": f"""WITH {_DUP}{_GENES_ANY}, ev AS (
  SELECT m.tid, g.s, g.e, ((rec_idx * 40503 + (row_number() OVER (PARTITION BY rec_idx ORDER BY g.i) - 1) * 7919) * 69069 % 1048573 % 20 + 1) * 5 AS pc
  FROM marked m JOIN gap g USING (rec_idx) WHERE m.flag & 772 = 0 AND NOT m.is_dup AND m.mapq >= 30),
fs AS (SELECT tid, s, e, min(pc) AS pc, (tid, s, e) IN (SELECT (tid, s, e) FROM mi) AS known FROM ev WHERE e - s >= 50 GROUP BY tid, s, e)
SELECT p::BIGINT AS percent, count(*) FILTER (pc <= p) AS all_junctions, count(*) FILTER (pc <= p AND known) AS known, count(*) FILTER (pc <= p AND NOT known) AS novel
FROM (SELECT unnest(range(5, 101, 5)) AS p) LEFT JOIN fs ON TRUE GROUP BY p""",
    "infer_experiment": f"""WITH {_DUP}{_GENES_ANY}, k AS (
  SELECT m.rec_idx, m.flag, m.tid, m.pos, m.pos + s.l_seq AS e FROM marked m JOIN shape s USING (rec_idx) WHERE flag & 772 = 0 AND NOT is_dup AND mapq >= 30),
o AS (SELECT k.rec_idx, any_value(k.flag) AS flag, any_value(k.tid) AS tid, any_value(k.pos) AS pos, bit_or(CASE WHEN strand = '+' THEN 1 ELSE 2 END) AS side
  FROM k JOIN tx ON tx.tid = k.tid AND tx.s < k.e AND tx.e > k.pos GROUP BY k.rec_idx),
c AS (SELECT * FROM o ORDER BY tid, pos, rec_idx LIMIT 200000)
SELECT CASE WHEN flag & 64 <> 0 THEN '1' ELSE '2' END || CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END || CASE side WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '-:+' END AS code, count(*) AS n
FROM c GROUP BY ALL""",
    "inner_distance": f"""WITH {_DUP}{_GENES_ANY}, c AS (
  SELECT rec_idx, tid, pos, mate_tid, mate_pos FROM marked WHERE flag & 1796 = 0 AND NOT is_dup AND flag & 1 <> 0 AND flag & 8 = 0 AND mapq >= 30
    AND (mate_pos > pos OR (mate_pos = pos AND flag & 64 = 0)) ORDER BY tid, pos, rec_idx LIMIT 1000000),
k AS (SELECT c.*, c.pos + s.query_length + s.intron_length AS r1 FROM c JOIN shape s USING (rec_idx) WHERE tid = mate_tid),
g AS (SELECT k.*, CASE WHEN mate_pos >= r1 THEN mate_pos - r1 ELSE -coalesce((SELECT sum(greatest(0, least(b.e, r1) - greatest(b.s, mate_pos))) FROM qcb b WHERE b.rec_idx = k.rec_idx), 0) END AS genomic FROM k),
ux AS (SELECT tid, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM gm)) GROUP BY tid, island),
gaps AS (SELECT DISTINCT tid, r1, mate_pos FROM g WHERE genomic > 0),
same AS (SELECT DISTINCT q.tid, q.r1, q.mate_pos FROM gaps q JOIN tx t ON t.tid = q.tid AND t.s <= q.r1 - 1 AND q.r1 - 1 < t.e AND t.s <= q.mate_pos AND q.mate_pos < t.e),
ex AS (SELECT q.tid, q.r1, q.mate_pos, sum(least(x.e, q.mate_pos) - greatest(x.s, q.r1)) AS exonic FROM same q JOIN ux x ON x.tid = q.tid AND x.s < q.mate_pos AND x.e > q.r1 GROUP BY ALL),
dist AS (SELECT CASE WHEN genomic > 0 THEN coalesce(exonic, genomic) ELSE genomic END AS v FROM g LEFT JOIN ex USING (tid, r1, mate_pos))
SELECT b::BIGINT AS bin_left, (b + 5)::BIGINT AS bin_right, count(v) AS n FROM (SELECT unnest(range(-250, 250, 5)) AS b) LEFT JOIN dist ON b < v AND v <= b + 5 GROUP BY b""",
    "pos_dup_hist": f"""WITH {_OPS}, b AS (SELECT rec_idx, list(struct_pack(s := s, e := e) ORDER BY s, e) AS bl FROM qcb GROUP BY rec_idx),
k AS (SELECT a.tid, a.pos, b.bl, count(*) AS occurrence FROM aln a LEFT JOIN b USING (rec_idx) WHERE a.flag & 516 = 0 AND a.mapq >= 30 GROUP BY ALL)
SELECT occurrence, count(*) AS n_keys FROM k GROUP BY occurrence""",
    "seq_dup_hist": "SELECT occurrence, count(*) AS n_keys FROM (SELECT text, count(*) AS occurrence FROM documents GROUP BY text) GROUP BY occurrence",
    "aln_qc": f"""WITH {_OPS}{_GENES}{_HITS}, k AS (SELECT a.*, coalesce(len(genes), 0) AS h, coalesce(nh > 1, FALSE) AS multi FROM aln a LEFT JOIN hits USING (rec_idx))
SELECT count(*) FILTER (flag & 2308 = 0 AND flag & 64 <> 0) AS left_reads, count(*) FILTER (flag & 2308 = 0 AND flag & 128 <> 0) AS right_reads,
  count(*) FILTER (flag & 256 <> 0) AS secondary, count(*) FILTER (flag & 256 = 0 AND multi) AS non_unique,
  count(*) FILTER (flag & 2308 = 0 AND NOT multi AND h = 1) AS gene, count(*) FILTER (flag & 2308 = 0 AND NOT multi AND h > 1) AS ambiguous,
  count(*) FILTER (flag & 2308 = 0 AND NOT multi AND h = 0) AS no_feature, count(DISTINCT qname) FILTER (flag & 2308 = 0 AND flag & 64 <> 0 AND flag & 2 <> 0) AS proper_pairs FROM k""",
}

# The chain's twin counts the rows of the twins above.
_PARTS = {
    "flagstat": "flagstat", "flagstat_post": "flagstat_post", "idxstats": "idxstats", "bam_stat": "bam_stat", "coverage": "coverage_sweep", "gene_counts": "gene_counts",
    "dup_matrix": "dup_matrix", "read_distribution": "read_distribution", "junctions": "junction_annotation", "junction_totals": "junction_totals",
    "junction_saturation": "junction_saturation", "infer_experiment": "infer_experiment", "inner_distance": "inner_distance", "pos_dup_hist": "pos_dup_hist", "aln_qc": "aln_qc",
}
ORACLES["chain"] = " UNION ALL ".join(f"SELECT '{name}' AS report, count(*) AS n_rows FROM ({ORACLES[twin]})" for name, twin in _PARTS.items())
