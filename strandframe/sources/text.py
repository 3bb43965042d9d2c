"""Text sources: gene annotations, gene models, reads, traces, timings, profiles and JSON sidecars.

All are plain ``spark.read.text`` or ``spark.read.csv`` scans with column functions; lines that do
not fit are handled as the docstrings say. Line order matters only where a format spreads
one record over several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block (where its split begins), line_no (from 0 within its file) and value of every line.

    Files are read whole-line but not in one task: lines get the id of their split and are
    numbered from the sizes of the splits before theirs.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    sizes = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["path", "block"]).select("path", "block", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "value")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Exons of a GTF: ord_no, chrom, feature, exon_start (0-based), exon_end, strand, gene_id.

    Rows with other than nine tab-parted fields and features other than ``exon`` are left
    out; an exon without gene_id raises an error when its row is read.
    """
    cut = numbered_lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    exons = cut.where((F.size("f") == 9) & (F.col("f")[2] == "exon"))
    gene = F.regexp_extract(F.col("f")[8], r'(?:^|;)\s*gene_id\s+"?([^";]+)"?', 1)
    return exons.select(
        F.col("line_no").alias("ord_no"), F.col("f")[0].alias("chrom"), F.col("f")[2].alias("feature"), (F.col("f")[3].cast("bigint") - 1).alias("exon_start"),
        F.col("f")[4].cast("bigint").alias("exon_end"), F.col("f")[6].alias("strand"),
        F.when(gene != "", gene).otherwise(F.raise_error(F.concat(F.lit("exon without gene_id: "), F.col("value")))).alias("gene_id"),
    )


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Gene models: chrom, start, end, name, score, strand, thick_start, thick_end, rgb, exons (array of start, end).

    Comment, track and browser lines and lines of fewer than twelve fields are left out.
    """
    cut = spark.read.text(path).where(~F.col("value").rlike("^(?:#|track|browser)")).withColumn("f", F.split(F.trim("value"), r"\s+")).where(F.size("f") >= 12)
    numbers = lambda i: F.filter(F.split(F.col("f")[i], ","), lambda x: x != "").cast("array<bigint>")
    start = F.col("f")[1].cast("bigint")
    exons = F.zip_with(numbers(11), numbers(10), lambda s, n: F.struct((start + s).alias("start"), (start + s + n).alias("end")))
    return cut.select(
        F.col("f")[0].alias("chrom"), start.alias("start"), F.col("f")[2].cast("bigint").alias("end"), F.col("f")[3].alias("name"), F.col("f")[4].alias("score"),
        F.col("f")[5].alias("strand"), F.col("f")[6].cast("bigint").alias("thick_start"), F.col("f")[7].cast("bigint").alias("thick_end"), F.col("f")[8].alias("rgb"), exons.alias("exons"),
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads: path, read_no, name, seq, qual. A record whose marks or lengths do not fit raises an error when read."""
    lines = numbered_lines(spark, path)
    part = lambda i: F.max(F.when(F.col("line_no") % 4 == i, F.col("value")))
    reads = lines.groupBy("path", F.floor(F.col("line_no") / 4).alias("read_no")).agg(part(0).alias("h"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
    ok = F.col("h").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")) & F.length("seq").between(1, 4096)
    checked = F.when(F.coalesce(ok, F.lit(False)), F.substring_index(F.expr("substring(h, 2)"), " ", 1)).otherwise(F.raise_error(F.concat(F.lit("bad read record: "), F.coalesce("h", F.lit("")))))
    return reads.select("path", "read_no", checked.alias("name"), "seq", "qual")


def encode_bases(seq: Column) -> tuple[Column, Column]:
    """A read's bases as digits 0 to 3 and their complement in place (not reversed); null if a base is not ACGT."""
    plain = F.upper(seq)
    ok = plain.rlike("^[ACGT]+$")
    return F.when(ok, F.translate(plain, "ACGT", "0123")), F.when(ok, F.translate(plain, "ACGT", "3210"))


def request_grid(reads: DataFrame, step: int = 20) -> DataFrame:
    """Search requests every ``step`` bases in both directions: path, read_no, dir, start, length, s0, s1.

    Forward requests reach to the read's end, backward ones (dir 0) to its begin. Reads with
    other bases than ACGT give none.
    """
    s0, s1 = encode_bases(F.col("seq"))
    coded = reads.select("path", "read_no", s0.alias("s0"), s1.alias("s1")).where("s0 IS NOT NULL")
    n = F.length("s0")
    starts = F.explode(F.sequence(F.lit(0), n - 1, F.lit(step)))
    grid = coded.select("*", starts.alias("start")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("dir"))
    return grid.select("path", "read_no", "dir", "start", F.when(F.col("dir") == 1, n - F.col("start")).otherwise(F.col("start") + 1).alias("length"), "s0", "s1")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A workflow trace: tab-parted with a header, all columns as text."""
    return spark.read.csv(path, sep="\t", header=True)


# Columns of the two layouts of timing tables.
TIMINGS = "repeat int, arm string, wall_s double, user_s double, sys_s double, max_rss_kib bigint, exit int"
STAGES = "stage string, wall_s double, user_s double, sys_s double, max_rss_kib bigint, threads int, exit int"


def read_timings(spark: SparkSession, path: str, layout: str = TIMINGS) -> DataFrame:
    """A timing table in one of the layouts. A row that did not exit with 0 raises an error, whichever columns are read."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=layout)
    failed = F.raise_error(F.concat(F.lit("run did not exit cleanly: "), F.coalesce(F.col(rows.columns[1] if layout == TIMINGS else rows.columns[0]), F.lit("")))).cast("boolean")
    return rows.where(F.when(F.col("exit") == 0, F.lit(True)).otherwise(failed))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profiler stacks: path, sample_no, thread, depth (0 is the leaf), symbol, module.

    A blank line or a thread line ends a sample. Frames before any thread line and lines that
    are neither raise an error when read.
    """
    is_thread = F.col("value").rlike(r"^\s*\d+\s*$")
    lines = numbered_lines(spark, path).withColumn("named", F.when(is_thread, F.trim("value")))
    # A split's lines are numbered in its own window; what goes from split to split is a count and a name.
    splits = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lines.groupBy("path", "block").agg(F.count("named").alias("n"), F.max_by("named", F.when(F.col("named").isNotNull(), F.col("line_no"))).alias("last")).select(
        "path", "block", F.coalesce(F.sum("n").over(splits), F.lit(0)).alias("before"), F.last("last", ignorenulls=True).over(splits).alias("open")
    )
    order = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(carried, ["path", "block"]).withColumns({
        "sample_no": F.col("before") + F.count("named").over(order), "thread": F.coalesce(F.last("named", ignorenulls=True).over(order), "open"),
    })
    frame = r"^\s+([0-9a-fA-F]+) (.+) \((.+)\)$"
    frames = marked.where(F.col("named").isNull() & (F.trim("value") != ""))
    ok = F.col("value").rlike(frame) & (F.col("sample_no") > 0)
    symbol = F.when(ok, F.regexp_extract("value", frame, 2)).otherwise(F.raise_error(F.concat(F.lit("unparsed line: "), F.col("value"))))
    depth = F.row_number().over(Window.partitionBy("path", "sample_no").orderBy("line_no")) - 1
    return frames.select("path", "sample_no", F.col("thread").cast("int").alias("thread"), depth.alias("depth"), symbol.alias("symbol"), F.substring_index(F.regexp_extract("value", frame, 3), "/", -1).alias("module"))


def profile_callers(frames: DataFrame, kernel: str = "[kernel.kallsyms]") -> DataFrame:
    """One row per sample: leaf symbol and module, and the first caller outside the kernel where the leaf is in it."""
    outside = F.when(F.col("module") != kernel, F.struct("depth", "symbol"))
    return frames.groupBy("path", "sample_no", "thread").agg(
        F.min_by("symbol", "depth").alias("leaf"), F.min_by("module", "depth").alias("module"), F.min(outside).alias("c")
    ).select("path", "sample_no", "thread", "leaf", "module", F.when(F.col("module") == kernel, F.coalesce("c.symbol", F.lit("[unresolved]"))).alias("caller"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as rows of path and payload, as the tables of JSON payloads hold them."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
