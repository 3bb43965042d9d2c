"""The alignment reports, as DataFrames.

``aln`` holds each record once (:func:`strandframe.operators.grouping.latest`); ``dups`` is
``rec_idx, is_duplicate`` from :func:`strandframe.operators.grouping.duplicates`. Null flags count
as 0, null tags NH as 1. Empty inputs give zero counts or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.functions.flags import (
    DUPLICATE, FIRST, LEAST_QUALITY, MATE_UNMAPPED, NOT_COUNTED_MULTI, NOT_DISTANCED, NOT_DISTRIBUTED, NOT_EXAMINED, NOT_POSITIONED,
    PAIRED, PROPER, QC_FAIL, REVERSE, SECOND, SECONDARY, SUPPLEMENTARY, UNMAPPED, has, lacks,
)
from strandframe.operators import annotation, intervals
from strandframe.operators.grouping import ordered_cap
from strandframe.session import written

INFER_CAP, DISTANCE_CAP, LEAST_INTRON = 200_000, 1_000_000, 50
PLACE = ["tid", "pos", "rec_idx"]


def with_duplicates(aln: DataFrame, dups: DataFrame) -> DataFrame:
    """``aln`` with a Boolean ``is_dup`` from the computed set."""
    marked = dups.where("is_duplicate").select("rec_idx", F.lit(True).alias("is_dup"))
    return aln.join(marked, "rec_idx", "left").withColumn("is_dup", F.coalesce("is_dup", F.lit(False)))


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def flagstat(aln: DataFrame, computed: bool = False) -> DataFrame:
    """One row of sixteen counters; with ``computed`` the set in ``is_dup`` counts as the duplicate bit."""
    primary, mapped = lacks(SECONDARY | SUPPLEMENTARY), lacks(UNMAPPED)
    duplicate = has(DUPLICATE) | F.col("is_dup") if computed else has(DUPLICATE)
    paired = primary & has(PAIRED)
    both = paired & mapped & lacks(MATE_UNMAPPED)
    apart = both & ~F.col("tid").eqNullSafe(F.col("mate_tid"))
    return aln.withColumn("flag", F.coalesce("flag", F.lit(0))).agg(
        F.count(F.lit(1)).alias("total"), _count(primary, "primary"), _count(has(SECONDARY), "secondary"),
        _count(has(SUPPLEMENTARY), "supplementary"), _count(duplicate, "duplicates"), _count(duplicate & primary, "primary_duplicates"),
        _count(mapped, "mapped"), _count(mapped & primary, "primary_mapped"), _count(paired, "paired"),
        _count(paired & has(FIRST), "read1"), _count(paired & has(SECOND), "read2"), _count(paired & mapped & has(PROPER), "proper"),
        _count(both, "both_mapped"), _count(paired & mapped & has(MATE_UNMAPPED), "singletons"),
        _count(apart, "different_chr"), _count(apart & (F.col("mapq") >= 5), "different_chr_mapq5"),
    )


def idxstats(aln: DataFrame, refs: DataFrame) -> DataFrame:
    """Per reference mapped and unmapped records, references without records included, and a last row ``*``."""
    counts = aln.groupBy(F.when(F.col("tid") >= 0, F.col("tid")).alias("tid")).agg(
        _count(lacks(UNMAPPED), "mapped"), _count(has(UNMAPPED), "unmapped"), F.count(F.lit(1)).alias("n")
    )
    known = refs.join(counts, "tid", "left").select(
        "tid", "ref_name", F.col("ref_length").cast("bigint").alias("ref_length"),
        F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"),
    )
    placeless = counts.where("tid IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unmapped")).select(
        F.lit(None).cast("int").alias("tid"), F.lit("*").alias("ref_name"), F.lit(0).cast("bigint").alias("ref_length"),
        F.lit(0).cast("bigint").alias("mapped"), "unmapped",
    )
    return known.unionByName(placeless)


def bam_stat(aln: DataFrame) -> DataFrame:
    """One row: a cascade of exclusive categories, and counters over the unique records. Needs ``is_dup``."""
    category = (
        F.when(has(QC_FAIL), "qc_fail").when(has(DUPLICATE) | F.col("is_dup"), "duplicate").when(has(SECONDARY), "non_primary")
        .when(has(UNMAPPED), "unmapped").when(F.col("mapq") < LEAST_QUALITY, "low_mapq").otherwise("unique")
    )
    is_ = lambda name: F.col("category") == name
    unique, spliced = is_("unique"), F.coalesce(F.col("cigar").contains("N"), F.lit(False))
    return aln.withColumn("category", category).agg(
        F.count(F.lit(1)).alias("total"), *[_count(is_(c), c) for c in ("qc_fail", "duplicate", "non_primary", "unmapped", "low_mapq", "unique")],
        _count(unique & has(FIRST), "read1"), _count(unique & has(SECOND), "read2"), _count(unique & lacks(REVERSE), "plus"),
        _count(unique & has(REVERSE), "minus"), _count(unique & spliced, "splice"), _count(unique & ~spliced, "non_splice"),
        _count(unique & has(PROPER), "proper"), _count(unique & has(PROPER) & ~F.col("tid").eqNullSafe(F.col("mate_tid")), "proper_different"),
    )


def duplication_metrics(aln: DataFrame, dups: DataFrame) -> DataFrame:
    """One row: examined and duplicate pairs and singles, and the share of duplicates."""
    left_out = aln.agg(_count(has(SECONDARY | SUPPLEMENTARY), "secondary_or_supplementary"),
                       _count(lacks(SECONDARY | SUPPLEMENTARY) & has(UNMAPPED), "unmapped"))
    both = aln.where(has(FIRST) & has(SECOND)).select("rec_idx", F.lit(2).alias("w"))
    # A pair has two records, or one that is its own mate.
    judged = dups.join(both, "rec_idx", "left").withColumn("half", F.when(F.col("is_pair"), F.coalesce("w", F.lit(1))).otherwise(0))
    counted = judged.agg(
        _count(~F.col("is_pair"), "unpaired_examined"), (F.coalesce(F.sum("half"), F.lit(0)) / 2).cast("bigint").alias("pairs_examined"),
        _count(~F.col("is_pair") & F.col("is_duplicate"), "unpaired_duplicates"),
        (F.coalesce(F.sum(F.when(F.col("is_duplicate"), F.col("half"))), F.lit(0)) / 2).cast("bigint").alias("pair_duplicates"),
    )
    examined = F.col("unpaired_examined") + 2 * F.col("pairs_examined")
    share = F.when(examined == 0, F.lit(0.0)).otherwise((F.col("unpaired_duplicates") + 2 * F.col("pair_duplicates")) / examined)
    return counted.withColumns({c: left_out.select(c).scalar() for c in left_out.columns}).withColumn("percent_duplication", F.round(share, 6))


def gene_hits(records: DataFrame, genes: DataFrame) -> DataFrame:
    """rec_idx and the sorted genes whose exons a record's coverage blocks overlap; records without a hit have no row.

    Records of one place and CIGAR overlap the same genes, so the join runs once per shape,
    not once per record: a crowded place costs one row.
    """
    shapes = records.select("tid", "pos", "cigar").distinct()
    blocks = shapes.select("tid", "pos", "cigar", F.inline(cigar.coverage_blocks(F.col("pos"), cigar.ops(F.col("cigar")))))
    exons = annotation.merged_exons(genes).select("tid", "gene_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hit = intervals.overlap_join(blocks, exons, ["tid"]).groupBy("tid", "pos", "cigar").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))
    return records.select("rec_idx", "tid", "pos", "cigar").join(hit, ["tid", "pos", "cigar"]).select("rec_idx", "genes")


def one_gene(a: Column, b: Column) -> Column:
    """The gene a fragment votes for: the only gene of one mate if the other hits none, else the only shared one."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    either = F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(F.array_intersect(a, b))
    return F.when(F.size(either) == 1, either[0])


def gene_counts(aln: DataFrame, genes: DataFrame) -> DataFrame:
    """gene_id, length, n_fragments of every gene.

    A fragment counts if each mate has at most one examined record and none maps to several
    places; records that are not exactly one of the two mates are passed over.
    """
    kept = aln.where(lacks(NOT_EXAMINED) & (has(FIRST) != has(SECOND)))
    hit = kept.join(gene_hits(kept, genes), "rec_idx", "left")
    fragments = hit.groupBy("qname").agg(
        _count(has(FIRST), "n1"), _count(has(SECOND), "n2"), F.max(F.coalesce("nh", F.lit(1))).alias("nh"),
        F.max(F.when(has(FIRST), F.col("genes"))).alias("a"), F.max(F.when(has(SECOND), F.col("genes"))).alias("b"),
    ).where("n1 <= 1 AND n2 <= 1 AND nh <= 1")
    votes = fragments.select(one_gene(F.col("a"), F.col("b")).alias("gene_id")).where("gene_id IS NOT NULL").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    return annotation.gene_lengths(genes).join(votes, "gene_id", "left").select("gene_id", "length", F.coalesce("n", F.lit(0)).alias("n_fragments"))


def duplication_matrix(aln: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts per gene in four modes (with and without multi-mappers and duplicates) and their rates. Needs ``is_dup``.

    In each mode the i-th record of one mate meets the i-th of the other, in order of the hit number
    (column ``hi``) if there is one and all records of the name in this mode have it, else of
    (mate position, record). Rates are per thousand bases and per million of the fragments of the first mode.
    """
    kept = aln.where(lacks(NOT_COUNTED_MULTI) & (has(FIRST) != has(SECOND)))
    multi = F.coalesce(F.col("nh") > 1, F.lit(False))
    inside = {0: F.lit(True), 1: ~F.col("is_dup"), 2: ~multi, 3: ~F.col("is_dup") & ~multi}
    rows = kept.join(gene_hits(kept, genes), "rec_idx", "left").withColumn("first", has(FIRST)).withColumns({f"in{m}": c for m, c in inside.items()})
    name, side = Window.partitionBy("qname"), Window.partitionBy("qname", "first")
    place = {m: F.col("mate_pos") for m in inside}
    if "hi" in aln.columns:
        place = {m: F.when(F.bool_and(F.when(F.col(f"in{m}"), F.col("hi").isNotNull())).over(name), F.col("hi")).otherwise(F.col("mate_pos")) for m in inside}
        rows = rows.withColumns({f"at{m}": c for m, c in place.items()})
        place = {m: F.col(f"at{m}") for m in inside}
    # The number of a record among its mate's in each mode is a running count: the rows are sorted once, not once per mode.
    nth = {m: F.sum(F.col(f"in{m}").cast("int")).over(side.orderBy(c, "rec_idx").rowsBetween(Window.unboundedPreceding, 0)) for m, c in place.items()}
    counted = rows.withColumns({f"i{m}": c for m, c in nth.items()})
    modes = F.filter(F.array(*[F.when(F.col(f"in{m}"), F.struct(F.lit(m).alias("mode"), F.col(f"i{m}").alias("i"))) for m in inside]), lambda x: x.isNotNull())
    fragments = counted.select("qname", "genes", "first", F.inline(modes)).groupBy("qname", "mode", "i").agg(
        F.max(F.when(F.col("first"), F.col("genes"))).alias("a"), F.max(F.when(~F.col("first"), F.col("genes"))).alias("b")
    )
    votes = fragments.groupBy("mode", one_gene(F.col("a"), F.col("b")).alias("gene_id")).agg(F.count(F.lit(1)).alias("n"))
    n = {m: F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("n"))), F.lit(0)) for m in range(4)}
    per_gene = votes.where("gene_id IS NOT NULL").groupBy("gene_id").agg(*[n[m].alias(f"n{m}") for m in range(4)])
    total = votes.where("mode = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    full = annotation.gene_lengths(genes).join(per_gene, "gene_id", "left").fillna(0, ["n0", "n1", "n2", "n3"]).withColumn("total", total)

    def rates(a: str, b: str, tail: str) -> list[Column]:
        x, y = F.col(a), F.col(b)
        per_kb = x * 1000.0 / F.col("length")
        return [
            x.alias(f"all_counts{tail}"), y.alias(f"filtered_counts{tail}"), F.round(F.try_divide(x - y, x), 6).alias(f"dup_rate{tail}"),
            (x - y).alias(f"dups_per_id{tail}"), F.round(per_kb, 6).alias(f"rpk{tail}"),
            F.round(F.when((x == 0) | (F.col("total") == 0), 0.0).otherwise(per_kb * 1e6 / F.col("total")), 6).alias(f"rpkm{tail}"),
        ]

    return full.select("gene_id", "length", *rates("n0", "n1", "_multi"), *rates("n2", "n3", ""))


def coverage(aln: DataFrame, refs: DataFrame) -> DataFrame:
    """Runs of equal depth: tid, start, end, depth; blocks are clamped to their reference."""
    kept = aln.where(lacks(UNMAPPED) & (F.col("tid") >= 0))
    blocks = kept.select("tid", F.inline(cigar.coverage_blocks(F.col("pos"), cigar.ops(F.col("cigar"))))).join(refs.select("tid", "ref_length"), "tid")
    inside = blocks.select("tid", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "ref_length").alias("end"))
    return intervals.depth(inside, ["tid"])


def position_duplication(aln: DataFrame) -> DataFrame:
    """How many (reference, position, blocks) occur how often."""
    kept = aln.where(lacks(NOT_POSITIONED) & (F.col("mapq") >= LEAST_QUALITY))
    blocks = cigar.qc_blocks(F.col("pos"), cigar.ops(F.col("cigar")))
    # CIGARs are counted before they are turned into blocks, which different CIGARs can share.
    counted = kept.groupBy("tid", "pos", "cigar").agg(F.count(F.lit(1)).alias("n")).select("tid", "pos", blocks.alias("blocks"), "n")
    return counted.groupBy("tid", "pos", "blocks").agg(F.sum("n").alias("occurrence")).groupBy("occurrence").agg(F.count(F.lit(1)).alias("n_keys"))


def read_distribution(aln: DataFrame, genes: DataFrame) -> DataFrame:
    """Tags per region class: class, bases, tags, tags_per_kb, and rows total_reads, total_tags and assigned_tags.

    A tag is a QC block's midpoint; it falls into a region that holds it strictly inside. The
    classes are tried in a fixed order; a tag near one end counts in the wider windows of
    that end as well. Needs ``is_dup``. Equal midpoints are counted before the look-up.
    """
    kept = aln.where(lacks(NOT_DISTRIBUTED) & ~F.col("is_dup"))
    tags = kept.groupBy("tid", "pos", "cigar").agg(F.count(F.lit(1)).alias("n")).select(
        "tid", "n", F.explode(cigar.qc_blocks(F.col("pos"), cigar.ops(F.col("cigar")))).alias("b")
    ).groupBy("tid", F.expr("b.start + (b.end - b.start) div 2").alias("point")).agg(F.sum("n").alias("n"))
    where = written(annotation.regions(genes))
    bit = F.create_map(*[x for i, c in enumerate(annotation.CLASSES) for x in (F.lit(c), F.lit(1 << i))])
    inside = intervals.stab_join(
        tags, where.select("tid", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.element_at(bit, F.col("class")).alias("bit")),
        ["tid"], closed_start=False,
    ).groupBy("tid", "point").agg(F.bit_or("bit").alias("bits"))
    marked = tags.join(inside, ["tid", "point"], "left").select("n", F.coalesce("bits", F.lit(0)).alias("bits"))
    at = {c: F.col("bits").bitwiseAND(1 << i) != 0 for i, c in enumerate(annotation.CLASSES)}
    names = lambda *cs: F.array(*[F.lit(c) for c in cs])
    nothing = F.array().cast("array<string>")
    chosen = (
        F.when(at["cds"], names("cds")).when(at["utr5"] & ~at["utr3"], names("utr5")).when(at["utr3"] & ~at["utr5"], names("utr3"))
        .when(at["utr5"] | at["utr3"], nothing).when(at["intron"], names("intron")).when(at["up10"] & at["down10"], nothing)
        .when(at["up1"], names("up1", "up5", "up10")).when(at["up5"], names("up5", "up10")).when(at["up10"], names("up10"))
        .when(at["down1"], names("down1", "down5", "down10")).when(at["down5"], names("down5", "down10")).when(at["down10"], names("down10"))
        .otherwise(nothing)
    )
    # The totals are counted as classes of their own, in the same pass.
    told = F.concat(chosen, names("total_tags"), F.when(F.size(chosen) > 0, names("assigned_tags")).otherwise(nothing))
    per = marked.groupBy(told.alias("told")).agg(F.sum("n").alias("n")).select(F.explode("told").alias("class"), "n")
    reads = kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_reads").alias("class"), "n")
    tagged = per.unionByName(reads).groupBy("class").agg(F.sum("n").alias("tags"))
    base = where.groupBy("class").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    all_classes = aln.sparkSession.createDataFrame([(c, c in annotation.CLASSES) for c in (*annotation.CLASSES, "total_reads", "total_tags", "assigned_tags")], "class string, region boolean")
    tags = F.coalesce("tags", F.lit(0)).cast("bigint")
    bases = F.when(F.col("region"), F.coalesce("bases", F.lit(0)).cast("bigint"))
    return all_classes.join(base, "class", "left").join(tagged, "class", "left").select(
        "class", bases.alias("bases"), tags.alias("tags"), F.round(tags * 1000.0 / (bases + 1), 6).alias("tags_per_kb")
    )


def junction_events(aln: DataFrame) -> DataFrame:
    """Introns of the kept records, short ones included: tid, start, end, n, first. Needs ``is_dup``.

    ``first`` is where the intron is met first: (position, record, number in the record).
    """
    kept = aln.where(lacks(NOT_DISTRIBUTED) & ~F.col("is_dup") & (F.col("mapq") >= LEAST_QUALITY) & F.col("cigar").contains("N"))
    spans = kept.select("tid", "pos", "rec_idx", F.posexplode(cigar.introns(F.col("pos"), cigar.ops(F.col("cigar")))).alias("i", "s"))
    return spans.groupBy("tid", F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "rec_idx", "i")).alias("first")
    )


def junctions(events: DataFrame, genes: DataFrame) -> DataFrame:
    """Kept introns with their kind: tid, start, end, n_reads, kind, known_pair, first.

    ``kind`` looks the start and the end up on their own; ``known_pair`` asks for both in one
    intron of the model.
    """
    model = annotation.model_introns(genes)
    starts = model.select("tid", "start", F.lit(True).alias("s_known")).distinct()
    ends = model.select("tid", "end", F.lit(True).alias("e_known")).distinct()
    pairs = model.select("tid", "start", "end", F.lit(True).alias("known_pair")).distinct()
    kept = events.where(F.col("end") - F.col("start") >= LEAST_INTRON)
    seen = kept.join(starts, ["tid", "start"], "left").join(ends, ["tid", "end"], "left").join(pairs, ["tid", "start", "end"], "left")
    s, e = F.col("s_known").isNotNull(), F.col("e_known").isNotNull()
    return seen.select(
        "tid", "start", "end", F.col("n").alias("n_reads"), F.when(s & e, "annotated").when(s | e, "partial_novel").otherwise("complete_novel").alias("kind"),
        F.coalesce("known_pair", F.lit(False)).alias("known_pair"), F.col("first.rec_idx").alias("first_rec_idx"),
    )


def junction_totals(events: DataFrame, genes: DataFrame) -> DataFrame:
    """Events and junctions by kind: kind, n_events, n_junctions; short introns are ``filtered``."""
    kinds = junctions(events, genes).groupBy("kind").agg(F.sum("n_reads").alias("n_events"), F.count(F.lit(1)).alias("n_junctions"))
    short = events.where(F.col("end") - F.col("start") < LEAST_INTRON).agg(
        F.lit("filtered").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.lit(0).cast("bigint").alias("n_junctions")
    )
    return kinds.unionByName(short)


def junction_saturation(aln: DataFrame, genes: DataFrame) -> DataFrame:
    """Distinct junctions after each twentieth of the events: percent, all_junctions, known, novel. Needs ``is_dup``.

    Events fall into twentieths by a hash of record and number, so the points before 100 %
    are those of one fixed random order.
    """
    kept = aln.where(lacks(NOT_DISTRIBUTED) & ~F.col("is_dup") & (F.col("mapq") >= LEAST_QUALITY) & F.col("cigar").contains("N"))
    spans = kept.select("tid", "rec_idx", F.posexplode(cigar.introns(F.col("pos"), cigar.ops(F.col("cigar")))).alias("i", "s")).where(
        F.col("s.end") - F.col("s.start") >= LEAST_INTRON
    )
    part = (((F.col("rec_idx") * 40_503 + F.col("i") * 7_919) * 69_069) % 1_048_573 % 20 + 1) * 5
    first = spans.groupBy("tid", F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.min(part).alias("percent"))
    pairs = annotation.model_introns(genes).select("tid", "start", "end", F.lit(1).alias("known")).distinct()
    new = first.join(pairs, ["tid", "start", "end"], "left").groupBy("percent").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k"))
    steps = aln.sparkSession.range(1, 21).select((F.col("id") * 5).alias("percent"))
    upto = Window.orderBy("percent").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.join(new, "percent", "left").select(
        "percent", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("all_junctions"), F.sum(F.coalesce("k", F.lit(0))).over(upto).alias("known")
    )
    return run.withColumn("novel", F.col("all_junctions") - F.col("known"))


def infer_experiment(aln: DataFrame, genes: DataFrame, most: int | None = INFER_CAP) -> DataFrame:
    """Strand protocol codes of the first ``most`` records that overlap a gene (None: of all): code, n. Needs ``is_dup``.

    A record reaches from its position over its read length (clips included). The code is
    mate, read strand and gene strand(s).
    """
    kept = aln.where(lacks(NOT_DISTRIBUTED) & ~F.col("is_dup") & (F.col("mapq") >= LEAST_QUALITY))
    length = cigar.total(cigar.ops(F.col("cigar")), ("M", "I", "S", "=", "X"))
    spans = kept.select("rec_idx", "flag", "tid", "pos", length.alias("l_seq"))
    shapes = spans.select("tid", F.col("pos").cast("bigint").alias("start"), (F.col("pos") + F.col("l_seq")).cast("bigint").alias("end")).distinct()
    tx = annotation.transcripts(genes).select("tid", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.when(F.col("strand") == "+", 1).otherwise(2).alias("side"))
    sides = intervals.overlap_join(shapes, tx, ["tid"], 16_384).groupBy("tid", "start", "end").agg(F.bit_or("side").alias("side"))
    joined = spans.withColumns({"start": F.col("pos").cast("bigint"), "end": (F.col("pos") + F.col("l_seq")).cast("bigint")}).join(sides, ["tid", "start", "end"])
    capped = ordered_cap(joined.select("tid", "pos", "rec_idx", "flag", "side"), PLACE, most)
    code = F.concat(
        F.when(has(FIRST), "1").otherwise("2"), F.when(has(REVERSE), "-").otherwise("+"),
        F.when(F.col("side") == 1, "+").when(F.col("side") == 2, "-").otherwise("-:+"),
    )
    return capped.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def inner_distance(aln: DataFrame, genes: DataFrame, most: int | None = DISTANCE_CAP) -> DataFrame:
    """Inner distances of the first ``most`` pairs (None: of all) in a hundred bins of five: bin_left, bin_right, n. Needs ``is_dup``.

    Pairs on two references count towards the cap but have no distance. Where both ends lie in
    one transcript the exonic bases between them are taken, if there are any.
    """
    ok = lacks(NOT_DISTANCED) & ~F.col("is_dup") & has(PAIRED) & lacks(MATE_UNMAPPED) & (F.col("mapq") >= LEAST_QUALITY)
    ahead = (F.col("mate_pos") > F.col("pos")) | ((F.col("mate_pos") == F.col("pos")) & lacks(FIRST))
    kept = ordered_cap(aln.where(ok & ahead).select(*PLACE, "mate_tid", "mate_pos", "cigar"), PLACE, most).where("tid = mate_tid")
    operations = cigar.ops(F.col("cigar"))
    end = F.col("pos") + cigar.query_length(operations) + cigar.total(operations, ("N",))
    # Equal pairs have equal distances and are worked out once.
    shapes = kept.groupBy("tid", "pos", "mate_pos", "cigar").agg(F.count(F.lit(1)).alias("n")).withColumn("r_end", end.cast("bigint"))
    low, high = F.col("mate_pos"), F.col("r_end")
    shared = F.aggregate(
        cigar.qc_blocks(F.col("pos"), operations), F.lit(0).cast("bigint"),
        lambda acc, b: acc + F.greatest(F.lit(0).cast("bigint"), F.least(b["end"], high) - F.greatest(b["start"], low)),
    )
    shapes = shapes.withColumn("genomic", F.when(low >= high, low - high).otherwise(-shared))
    gap = shapes.where("genomic > 0").select("tid", F.col("r_end").alias("gap_start"), F.col("mate_pos").cast("bigint").alias("gap_end")).distinct()
    tx = annotation.transcripts(genes).select("tid", "gene_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    at = lambda c, name: intervals.stab_join(gap.withColumn("point", c), tx, ["tid"], width=16_384).select("tid", "gap_start", "gap_end", F.col("gene_id").alias(name))
    both = at(F.col("gap_start") - 1, "g").join(at(F.col("gap_end"), "h"), ["tid", "gap_start", "gap_end"]).where("g = h").select("tid", "gap_start", "gap_end").distinct()
    exons = intervals.union(annotation.merged_exons(genes), ["tid"]).select("tid", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    bases = intervals.overlap_join(both, exons, ["tid"], 4096, ("gap_start", "gap_end")).groupBy("tid", "gap_start", "gap_end").agg(
        F.sum(F.least("gap_end", "r_end") - F.greatest("gap_start", "r_start")).alias("exonic")
    )
    found = shapes.withColumns({"gap_start": F.col("r_end"), "gap_end": F.col("mate_pos").cast("bigint")}).join(bases, ["tid", "gap_start", "gap_end"], "left")
    distance = F.when(F.col("genomic") > 0, F.coalesce("exonic", "genomic")).otherwise(F.col("genomic"))
    left = (F.ceil(distance / 5) - 1) * 5
    counted = found.groupBy(left.cast("bigint").alias("bin_left")).agg(F.sum("n").alias("n"))
    bins = aln.sparkSession.range(-50, 50).select((F.col("id") * 5).alias("bin_left"))
    return bins.join(counted, "bin_left", "left").select("bin_left", (F.col("bin_left") + 5).alias("bin_right"), F.coalesce("n", F.lit(0)).alias("n"))


def alignment_qc(aln: DataFrame, genes: DataFrame) -> DataFrame:
    """One row of counters: mates, proper pairs by name, secondaries, multi-mappers and gene hits."""
    multi = F.coalesce(F.col("nh") > 1, F.lit(False))
    examined = lacks(NOT_EXAMINED)
    part = aln.join(gene_hits(aln.where(examined & ~multi), genes), "rec_idx", "left")
    voting = examined & ~multi
    hits = F.when(F.col("genes").isNull(), 0).otherwise(F.size("genes"))
    names = part.where(examined & has(FIRST) & has(PROPER)).agg(F.count_distinct("qname").alias("proper_pairs"))
    counted = part.agg(
        _count(examined & has(FIRST), "left_reads"), _count(examined & has(SECOND), "right_reads"), _count(has(SECONDARY), "secondary"),
        _count(lacks(SECONDARY) & multi, "non_unique"), _count(voting & (hits == 1), "gene"), _count(voting & (hits > 1), "ambiguous"), _count(voting & (hits == 0), "no_feature"),
    )
    return counted.withColumn("proper_pairs", names.scalar())


def region_query(aln: DataFrame, region: DataFrame) -> DataFrame:
    """Records that overlap regions: region_id, rec_idx. Unmapped records with a place are one base long."""
    length = F.when(lacks(UNMAPPED), F.greatest(cigar.reference_length(cigar.ops(F.col("cigar"))), F.lit(1))).otherwise(1)
    spans = aln.where((F.col("tid") >= 0) & (F.col("pos") >= 0)).select("rec_idx", "tid", F.col("pos").cast("bigint").alias("start"), (F.col("pos") + length).cast("bigint").alias("end"))
    return intervals.overlap_join(spans, region, ["tid"], 16_384).select("region_id", "rec_idx")
