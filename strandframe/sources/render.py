"""Report texts and tables.

One-row reports become a text on the driver; tables with a row per gene, run or junction are
written by Spark, sorted, one line per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines of the flag statistics, with the counters they show and the base of their percentage.
FLAGSTAT_LINES = (
    ("total", "in total (QC-passed reads + QC-failed reads)", None), ("primary", "primary", None), ("secondary", "secondary", None),
    ("supplementary", "supplementary", None), ("duplicates", "duplicates", None), ("primary_duplicates", "primary duplicates", None),
    ("mapped", "mapped", "total"), ("primary_mapped", "primary mapped", "primary"), ("paired", "paired in sequencing", None),
    ("read1", "read1", None), ("read2", "read2", None), ("proper", "properly paired", "paired"), ("both_mapped", "with itself and mate mapped", None),
    ("singletons", "singletons", "paired"), ("different_chr", "with mate mapped to a different chr", None),
    ("different_chr_mapq5", "with mate mapped to a different chr (mapQ>=5)", None),
)
# Labels and widths of the record statistics.
BAM_STAT_LINES = (
    ("Total records:", "total"), ("", None), ("QC failed:", "qc_fail"), ("Optical/PCR duplicate:", "duplicate"), ("Non primary hits", "non_primary"),
    ("Unmapped reads:", "unmapped"), ("mapq < mapq_cut (non-unique):", "low_mapq"), ("", None), ("mapq >= mapq_cut (unique):", "unique"), ("Read-1:", "read1"),
    ("Read-2:", "read2"), ("Reads map to '+':", "plus"), ("Reads map to '-':", "minus"), ("Non-splice reads:", "non_splice"), ("Splice reads:", "splice"),
    ("Reads mapped in proper pairs:", "proper"), ("Proper-paired reads map to different chrom:", "proper_different"),
)
# Columns of the duplication metrics.
METRICS = (
    ("UNPAIRED_READS_EXAMINED", "unpaired_examined"), ("READ_PAIRS_EXAMINED", "pairs_examined"), ("SECONDARY_OR_SUPPLEMENTARY_RDS", "secondary_or_supplementary"),
    ("UNMAPPED_READS", "unmapped"), ("UNPAIRED_READ_DUPLICATES", "unpaired_duplicates"), ("READ_PAIR_DUPLICATES", "pair_duplicates"),
)


def flagstat_text(report: DataFrame) -> str:
    """Sixteen lines; percentages have two places, or N/A over nothing."""
    r = report.first().asDict()

    def line(name, label, base):
        share = ""
        if base:
            share = f" ({r[name] * 100 / r[base]:.2f}% : N/A)" if r[base] else " (N/A : N/A)"
        return f"{r[name]} + 0 {label}{share}\n"

    return "".join(line(*x) for x in FLAGSTAT_LINES)


def bam_stat_text(report: DataFrame) -> str:
    r = report.first().asDict()
    rule = "#" + "=" * 50
    head = f"\n{rule}\n#All numbers are READ count\n{rule}\n\n"
    return head + "".join(f"{label:<40}{r[name]}\n" if name else "\n" for label, name in BAM_STAT_LINES)


def metrics_text(report: DataFrame, library: str = "Unknown Library") -> str:
    """Header and row of the duplication metrics; no optical duplicates, no library size."""
    r = report.first().asDict()
    names = ["LIBRARY", *[n for n, _ in METRICS], "READ_PAIR_OPTICAL_DUPLICATES", "PERCENT_DUPLICATION", "ESTIMATED_LIBRARY_SIZE"]
    values = [library, *[str(r[c]) for _, c in METRICS], "0", f"{r['percent_duplication']:.6f}", ""]
    return "\t".join(names) + "\n" + "\t".join(values) + "\n"


def infer_text(codes: DataFrame) -> str:
    """Shares of the two strand protocols and of the rest, four places; NaN over nothing."""
    n = {r.code: r.n for r in codes.collect()}
    total, a = sum(n.values()), sum(n.get(c, 0) for c in ("1++", "1--", "2+-", "2-+"))
    b = sum(n.get(c, 0) for c in ("1+-", "1-+", "2++", "2--"))
    share = lambda x: f"{x / total:.4f}" if total else "NaN"
    return (
        f"\n\nThis is PairEnd Data\nFraction of reads failed to determine: {share(total - a - b)}\n"
        f'Fraction of reads explained by "1++,1--,2+-,2-+": {share(a)}\nFraction of reads explained by "1+-,1-+,2++,2--": {share(b)}\n'
    )


def distribution_text(report: DataFrame) -> str:
    """The read distribution: three totals, then a row per class in order."""
    rows = {r["class"]: r for r in report.collect()}
    labels = {
        "cds": "CDS_Exons", "utr5": "5'UTR_Exons", "utr3": "3'UTR_Exons", "intron": "Introns", "up1": "TSS_up_1kb", "up5": "TSS_up_5kb", "up10": "TSS_up_10kb",
        "down1": "TES_down_1kb", "down5": "TES_down_5kb", "down10": "TES_down_10kb",
    }
    totals = "".join(f"{label:<30}{rows[k]['tags']}\n" for k, label in (("total_reads", "Total Reads"), ("total_tags", "Total Tags"), ("assigned_tags", "Total Assigned Tags")))
    rule = "=" * 69 + "\n"
    body = "".join(f"{labels[c]:<20}{rows[c]['bases']:<20}{rows[c]['tags']:<20}{rows[c]['tags_per_kb']:<18.2f}\n" for c in labels)
    return totals + rule + f"{'Group':<20}{'Total_bases':<20}{'Tag_count':<20}{'Tags/Kb':<18}\n" + body + rule


def qc_text(report: DataFrame) -> str:
    """Counters with thousands grouped, gene shares with two places."""
    r = report.first().asDict()
    votes = r["gene"] + r["ambiguous"] + r["no_feature"]
    share = lambda x: f" / {x * 100 / votes:.2f}%" if votes else ""
    shown = {k: f"{v:,}" + (share(v) if k in ("gene", "ambiguous", "no_feature") else "") for k, v in r.items()}
    return "".join(f"{k.replace('_', ' ')} = {v}\n" for k, v in shown.items())


def _lines(df: DataFrame, order: list, columns: list[Column | str], path: str) -> None:
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("NA")) for c in columns])
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(text.alias("value")).write.text(path)


def write_idxstats(report: DataFrame, path: str) -> None:
    """References in header order, the row ``*`` last."""
    last = F.coalesce("tid", F.lit(2**31 - 1))
    _lines(report.withColumn("o", last), ["o"], ["ref_name", "ref_length", "mapped", "unmapped"], path)


def write_bedgraph(runs: DataFrame, refs: DataFrame, path: str) -> None:
    """Runs of depth over 0 in header order."""
    _lines(runs.join(refs.select("tid", "ref_name"), "tid"), ["tid", "start"], ["ref_name", "start", "end", "depth"], path)


def write_gene_counts(counts: DataFrame, exons: DataFrame, path: str) -> None:
    """Genes in order of first appearance: exon lists joined with ';' (as given, 1-based), merged length and count."""
    order = F.array_sort(F.collect_list(F.struct("ord_no", "chrom", (F.col("exon_start") + 1).alias("s"), F.col("exon_end").alias("e"), "strand")))
    lists = exons.where("feature = 'exon'").groupBy("gene_id").agg(F.min("ord_no").alias("o"), order.alias("x"))
    joined = counts.join(lists, "gene_id")
    field = lambda f: F.array_join(F.transform("x", lambda e: F.coalesce(e[f].cast("string"), F.lit("."))), ";")
    _lines(joined, ["o"], ["gene_id", field("chrom"), field("s"), field("e"), field("strand"), "length", "n_fragments"], path)


def write_junctions(found: DataFrame, refs: DataFrame, path: str) -> None:
    """Junctions in the order they are met; the label has a leading blank."""
    named = found.join(refs.select("tid", "ref_name"), "tid")
    _lines(named, ["tid", "first_rec_idx", "start"], ["ref_name", "start", "end", "n_reads", F.concat(F.lit(" "), "kind")], path)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """How many keys occur how often, by occurrence."""
    _lines(histogram, ["occurrence"], ["occurrence", "n_keys"], path)


def write_inner_distance(bins: DataFrame, path: str) -> None:
    """Inner distances by bin."""
    _lines(bins, ["bin_left"], ["bin_left", "bin_right", "n"], path)


def write_saturation(steps: DataFrame, path: str) -> None:
    """Junctions after each share of the events: the numbers of the saturation plot."""
    _lines(steps, ["percent"], ["percent", "known", "all_junctions", "novel"], path)


# Labels of the junction summary.
_JUNCTION_KINDS = (("Known Splicing", "annotated"), ("Partial Novel Splicing", "partial_novel"), ("Novel Splicing", "complete_novel"))


def junction_log_text(totals: DataFrame) -> str:
    """Events and junctions by kind (four rows), with short introns as filtered events."""
    n = {r.kind: (r.n_events, r.n_junctions) for r in totals.collect()}
    get = lambda kind, i: n.get(kind, (0, 0))[i]
    out = []
    for i, unit in enumerate(("Events", "Junctions")):
        # Filtered events are part of the total, they have no junctions.
        out.append(f"Total splicing  {unit}:\t{sum(v[i] for v in n.values())}\n")
        out += [f"{label} {unit}:\t{get(kind, i)}\n" for label, kind in _JUNCTION_KINDS]
        out.append(f"Filtered Splicing Events:\t{get('filtered', 0)}\n\n" if i == 0 else "")
    return "".join(out)


def distribution_json(report: DataFrame, keys: list[str]) -> str:
    """Distributions (:func:`strandframe.operators.measures.distribution`) as one JSON text, an object per group; one row per group is read."""
    import json

    out = {}
    for r in report.collect():
        row = r.asDict()
        bins = dict(part.split(":") for part in row["log2_histogram"].split(",") if part)
        out["/".join(str(row[k]) for k in keys)] = {**{c: row[c] for c in ("mean_value", "q1_2", "q9_10", "q99_100", "q1_1")}, "log2_histogram": {k: int(v) for k, v in bins.items()}}
    return json.dumps(out, indent=2, sort_keys=True)


def write_repeats(repeats: DataFrame, path: str) -> None:
    """The rows of a measured comparison, one per repeat, numbers of seconds with nine places."""
    place = lambda c: F.format_string("%.9f", F.col(c))
    _lines(repeats, ["host", "arm", "rep_no"], ["host", "arm", "rep_no", place("cpu_s"), place("gpu_s"), F.format_string("%.6f", F.col("speedup"))], path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """The duplication matrix, ``NA`` where a rate has no base."""
    _lines(matrix, ["gene_id"], matrix.columns, path)


def write_records(records: DataFrame, path: str) -> None:
    """Records by reference, sorted by place within files, with their index bin: scans for a region skip the rest."""
    from strandframe.functions.flags import reg2bin

    end = F.col("pos") + F.greatest(F.coalesce("ref_len", F.lit(1)), F.lit(1))
    binned = records.withColumn("bin", F.when(F.col("tid") >= 0, reg2bin(F.col("pos"), end)))
    binned.repartitionByRange("tid", "pos", "rec_idx").sortWithinPartitions("tid", "pos", "rec_idx").write.partitionBy("tid").parquet(path)


def mark_flags(records: DataFrame, dups: DataFrame) -> DataFrame:
    """Records with the duplicate bit set for the computed set; a bit that is set stays."""
    from strandframe.operators.reports import with_duplicates

    marked = with_duplicates(records, dups)
    return marked.withColumn("flag", F.when(F.col("is_dup"), F.col("flag").bitwiseOR(0x400)).otherwise(F.col("flag"))).drop("is_dup")
