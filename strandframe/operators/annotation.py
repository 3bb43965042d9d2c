"""Genes, transcript models and region classes from exon rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators import intervals

#: Region classes in the order in which a tag is tested against them.
CLASSES = ("cds", "utr5", "utr3", "intron", "up1", "up5", "up10", "down1", "down5", "down10")
REACH = {"1": 1_000, "5": 5_000, "10": 10_000}
#: Without coding bounds in the annotation, a transcript's span less this many bases on both sides counts as coding.
THICK_MARGIN = 10


def gene_exons(exons: DataFrame, refs: DataFrame, any_case: bool = False) -> DataFrame:
    """Exon rows on references: gene_id, tid, strand, start, end, ord_no.

    A gene lies on the reference and strand of its first exon (by ``ord_no``), all its exons
    with it. Names match exactly, or in any case with ``any_case``; genes on unknown
    references and rows without gene or other than exons are left out.
    """
    rows = exons.where((F.col("feature") == "exon") & F.col("gene_id").isNotNull())
    first = rows.groupBy("gene_id").agg(F.min(F.struct("ord_no", "chrom", "strand")).alias("f"))
    name = (lambda c: F.upper(c)) if any_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    placed = first.select("gene_id", name(F.col("f.chrom")).alias("name"), F.col("f.strand").alias("strand")).join(
        refs.select("tid", name(F.col("ref_name")).alias("name")), "name"
    )
    return rows.select("gene_id", "ord_no", F.col("exon_start").alias("start"), F.col("exon_end").alias("end")).join(placed.drop("name"), "gene_id")


def merged_exons(genes: DataFrame) -> DataFrame:
    """Disjoint exons per gene: gene_id, tid, start, end."""
    return intervals.union(genes, ["gene_id", "tid"])


def gene_lengths(genes: DataFrame) -> DataFrame:
    """gene_id, length: bases of the merged exons."""
    return intervals.covered(merged_exons(genes), ["gene_id"]).withColumnRenamed("bases", "length")


def transcripts(genes: DataFrame) -> DataFrame:
    """One model per gene: gene_id, tid, start, end, strand, thick_start, thick_end."""
    return genes.groupBy("gene_id", "tid", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumns({
        "thick_start": F.col("start") + THICK_MARGIN, "thick_end": F.col("end") - THICK_MARGIN,
    })


def model_introns(genes: DataFrame) -> DataFrame:
    """Gaps between consecutive merged exons: gene_id, tid, start, end."""
    order = Window.partitionBy("gene_id", "tid").orderBy("start")
    return merged_exons(genes).select("gene_id", "tid", F.col("end").alias("start"), F.lead("start").over(order).alias("end")).where("end IS NOT NULL")


def regions(genes: DataFrame) -> DataFrame:
    """Disjoint regions per class and reference: class, tid, start, end.

    Coding beats the untranslated ends, those beat introns, and those beat the windows of
    1, 5 and 10 kb around a transcript, which are clipped at 0 on the left only. A strand
    other than + counts as minus.
    """
    tx = transcripts(genes)
    exons = merged_exons(genes).join(tx.select("gene_id", "tid", "strand", "thick_start", "thick_end"), ["gene_id", "tid"])
    plus = F.coalesce(F.col("strand") == "+", F.lit(False))

    def span(name: Column | str, start: Column, end: Column) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.alias("class"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))

    left, right = F.least("end", "thick_start"), F.greatest("start", "thick_end")
    side = lambda e: F.when((e <= F.col("thick_start")) == plus, "utr5").otherwise("utr3")
    parts = exons.select("tid", F.inline(F.array(
        span("cds", F.greatest("start", "thick_start"), F.least("end", "thick_end")),
        span(side(left), F.col("start"), left), span(side(F.col("end")), right, F.col("end")),
    )))
    around = []
    for name, reach in REACH.items():
        before = (F.greatest(F.col("start") - reach, F.lit(0)), F.col("start"))
        after = (F.col("end"), F.col("end") + reach)
        around += [
            span(F.when(plus, f"up{name}").otherwise(f"down{name}"), *before), span(F.when(plus, f"down{name}").otherwise(f"up{name}"), *after),
        ]
    windows = tx.select("tid", F.inline(F.array(*around)))
    gaps = model_introns(genes).select("tid", F.lit("intron").alias("class"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    raw = parts.unionByName(windows).unionByName(gaps).where("start < end")
    # All classes are cut in one sweep, each by the stronger ones.
    weight = {"cds": ["utr5", "utr3", "intron"], "utr5": ["intron"], "utr3": ["intron"], "intron": []}
    outer = [c for c in CLASSES if c.startswith(("up", "down"))]
    stronger = {c: [s for s, weaker in weight.items() if c in weaker] if c not in outer else list(weight) for c in CLASSES}
    targets = F.create_map(*[x for s in weight for x in (F.lit(s), F.array(*[F.lit(c) for c in CLASSES if s in stronger[c]]))])
    cut = raw.where(F.col("class").isin(*weight)).select("tid", F.explode(F.element_at(targets, F.col("class"))).alias("class"), "start", "end")
    return intervals.subtract(raw, cut, ["class", "tid"])
