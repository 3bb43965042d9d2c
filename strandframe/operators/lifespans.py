"""Schemas that drift between files: a catalogue of column lifespans.

Each file's fields are exploded to rows (producer, position in the series, field,
type, value). ``lag``/``lead`` per producer and field cut the rows into islands, the
lifespans; an island that starts or ends inside the series is an event at the file
where it happens. A start whose value is that of exactly one field that ended there is
a rename. Renames chain into lineages, which give the alias table from which the
unified table's names and casts are made.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.jsonwalk import leaf_fields, top_fields

SERIES = ["source", "producer"]


def file_fields(files: DataFrame, source: str, fields) -> DataFrame:
    """One row per file of a table: source, producer, file_id, seq, next_file_id, fields.

    Deliveries of one ``file_id`` count once, the latest by ``received_at`` stands (ties:
    the greatest payload). Files without id, producer or readable JSON object are no part
    of a series. ``seq`` counts from 1 in the order of ``captured_at``, then ``file_id``.
    """
    once = files.where(F.col("file_id").isNotNull() & F.col("evidence_dir").isNotNull()).groupBy("file_id").agg(
        F.max(F.struct("received_at", "payload", "captured_at", "evidence_dir")).alias("f")
    )
    read = once.select(
        F.lit(source).alias("source"), F.col("f.evidence_dir").alias("producer"), "file_id",
        F.col("f.captured_at").alias("captured_at"), fields(F.col("f.payload")).alias("fields"),
    ).where(F.col("fields").isNotNull())
    order = Window.partitionBy(*SERIES).orderBy("captured_at", "file_id")
    return read.withColumn("seq", F.row_number().over(order)).withColumn("next_file_id", F.lead("file_id").over(order))


def lifespan_rows(files: DataFrame) -> DataFrame:
    """The fields of :func:`file_fields` as rows with island numbers and the last known type.

    Columns: source, producer, file_id, next_file_id, seq, field, jtype, value, nested,
    starts, ends, island, last_type. A null keeps the field's last type. The empty field list of a
    file gives no rows, but its neighbours still see the gap.
    """
    rows = files.select(*SERIES, "file_id", "next_file_id", "seq", F.inline("fields"))
    series = Window.partitionBy(*SERIES, "field").orderBy("seq")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("jtype") != "null", F.col("jtype"))
    prev, after = F.lag("seq").over(series), F.lead("seq").over(series)
    marked = rows.select(
        "*",
        (prev.isNull() | (prev < F.col("seq") - 1)).alias("starts"),
        (after.isNull() | (after > F.col("seq") + 1)).alias("ends"),
        F.last(known, ignorenulls=True).over(before).alias("last_type"),
    )
    return marked.withColumn("island", F.sum(F.col("starts").cast("int")).over(series.rowsBetween(Window.unboundedPreceding, 0)))


def lifespans(rows: DataFrame) -> DataFrame:
    """One row per lifespan: first and last file and position, number of files, types seen."""
    return rows.groupBy(*SERIES, "field", "island").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min_by("file_id", "seq").alias("first_file_id"), F.max_by("file_id", "seq").alias("last_file_id"),
        F.count(F.lit(1)).alias("n_files"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("jtype") != "null", F.col("jtype")))), ",").alias("types"),
    )


def changes(rows: DataFrame) -> DataFrame:
    """Every change: source, producer, file_id, field_name, change_kind, old_name, old_island, old_type, new_type, island.

    Input from :func:`lifespan_rows`. ``file_id`` is the file where the change shows. The
    first file of a series has no rows. Values are compared as text; a rename needs one
    field, and no more, that ended at this file with the same non-null scalar.
    """
    start = rows.where(F.col("starts") & (F.col("seq") > 1)).select(
        *SERIES, "file_id", "value", F.struct("field", "jtype", "last_type", "island").alias("s"),
        F.lit(None).cast("struct<field:string,jtype:string,island:bigint>").alias("e"),
    )
    end = rows.where(F.col("ends") & F.col("next_file_id").isNotNull()).select(
        *SERIES, F.col("next_file_id").alias("file_id"), "value",
        F.lit(None).cast("struct<field:string,jtype:string,last_type:string,island:bigint>").alias("s"),
        F.struct("field", F.when(F.col("jtype") != "null", F.col("jtype")).otherwise(F.col("last_type")).alias("jtype"), "island").alias("e"),
    )
    # A group is the changes of one file that share a value: bounded by the file's fields.
    met = start.unionByName(end).groupBy(*SERIES, "file_id", "value").agg(
        F.collect_list("s").alias("born"), F.collect_list("e").alias("gone")
    )
    renamed = F.col("value").isNotNull() & (F.size("gone") == 1) & (F.size("born") > 0)
    none = F.lit(None).cast("string")

    def row(kind, name, island, new_type, old, old_island, old_type):
        return F.struct(
            name.alias("field_name"), F.lit(kind).alias("change_kind"), old.alias("old_name"), old_island.cast("bigint").alias("old_island"),
            old_type.alias("old_type"), new_type.alias("new_type"), island.cast("bigint").alias("island"),
        )

    first = F.col("gone")[0]
    as_renamed = F.transform("born", lambda b: row("renamed", b["field"], b["island"], b["jtype"], first["field"], first["island"], first["jtype"]))
    as_added = F.transform("born", lambda b: row("added", b["field"], b["island"], b["jtype"], none, none, none))
    as_removed = F.transform("gone", lambda g: row("removed", g["field"], none, none, g["field"], g["island"], g["jtype"]))
    events = met.select(
        *SERIES, "file_id", F.inline(F.when(renamed, as_renamed).otherwise(F.concat(as_added, as_removed)))
    )
    moved = events.where((F.col("change_kind") == "renamed") & (F.col("old_type") != F.col("new_type"))).withColumn("change_kind", F.lit("retyped"))
    stayed = rows.where(~F.col("starts") & (F.col("jtype") != "null") & (F.col("jtype") != F.col("last_type"))).select(
        *SERIES, "file_id", F.col("field").alias("field_name"), F.lit("retyped").alias("change_kind"),
        F.col("field").alias("old_name"), F.col("island").cast("bigint").alias("old_island"), F.col("last_type").alias("old_type"),
        F.col("jtype").alias("new_type"), F.col("island").cast("bigint").alias("island"),
    )
    return events.unionByName(moved).unionByName(stayed)


def _roots(events: pd.DataFrame) -> pd.DataFrame:
    """Follows the renames of one series in order; the earliest name of a lifespan's lineage stands for it.

    A field that ended and came back is another lifespan, and so another lineage.
    """
    root: dict[tuple, str] = {}
    out = []
    for r in events.sort_values(["seq", "field_name"]).itertuples():
        start = root.get((r.old_name, r.old_island), r.old_name)
        root[r.field_name, r.island] = start
        out.append((r.source, r.producer, r.field_name, r.island, start))
    return pd.DataFrame(out, columns=["source", "producer", "field", "island", "canonical"])


#: A scalar read as a number, thousands separators dropped; null if it is none.
NUMBER = "try_cast(regexp_replace(value, '(?<=[0-9]),(?=[0-9]{3})', '') as decimal(28,9))"


def alias_table(rows: DataFrame, log: DataFrame) -> DataFrame:
    """source, producer, field, island, canonical, target_type: lineage name and type of every lifespan.

    The type is that of the whole lineage: ``json`` if any of its files holds an array or
    object, ``decimal`` if a number was written in any or all its values read as numbers,
    ``boolean`` if it holds nothing else, ``string`` otherwise; null if all are null. Groups of
    ``_roots`` are the renames of one series; the series grow in number, not in length, so a
    group stays small.
    """
    named = log.where(F.col("change_kind") == "renamed").select(*SERIES, "file_id", "field_name", "old_name", "old_island", "island")
    at = rows.where("starts").select(*SERIES, "file_id", F.col("field").alias("field_name"), "seq")
    events = named.join(at, [*SERIES, "file_id", "field_name"])
    renamed = events.groupBy(*SERIES).applyInPandas(
        _roots, "source string, producer string, field string, island bigint, canonical string"
    )
    has = lambda *kinds: F.bool_or(F.col("jtype").isin(*kinds))
    spans = rows.groupBy(*SERIES, "field", "island").agg(
        has("array", "object").alias("json"), has("integer", "float").alias("number"), has("boolean").alias("boolean"),
        has("string").alias("string"), F.bool_and(F.when(F.col("jtype") == "string", F.expr(NUMBER).isNotNull())).alias("reads"),
    ).join(renamed, [*SERIES, "field", "island"], "left").withColumn("canonical", F.coalesce("canonical", "field"))
    types = spans.groupBy(*SERIES, "canonical").agg(
        *[F.bool_or(c).alias(c) for c in ("json", "number", "boolean", "string")], F.bool_and("reads").alias("reads")
    ).select(
        *SERIES, "canonical",
        F.when(F.col("json"), "json").when(F.col("boolean") & ~F.col("number") & ~F.col("string"), "boolean")
        .when(~F.col("boolean") & (F.col("number") | F.col("reads")), "decimal")
        .when(F.col("boolean") | F.col("string"), "string").alias("target_type"),
    )
    return spans.select(*SERIES, "field", "island", "canonical").join(types, [*SERIES, "canonical"])


def unified(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """All files in one long table: source, producer, file_id, seq, field_name, source_name, json_type, target_type and values.

    ``field_name`` and ``target_type`` are the lineage's of the alias table. ``value_text`` is a
    scalar as written. ``value_num``, ``value_bool`` and ``value_json`` are casts to the
    lineage's type, null where it is another one; arrays and objects, and the scalars of their
    lineages, are JSON text in ``value_json``.
    """
    joined = rows.join(aliases, [*SERIES, "field", "island"], "left")
    quoted = F.when(F.col("jtype") == "string", F.expr("regexp_replace(to_json(array(value)), '^.|.$', '')")).otherwise(F.col("value"))

    def of(kind, value):
        return F.when(F.col("target_type") == kind, value)

    return joined.select(
        "source", "producer", "file_id", "seq", F.col("canonical").alias("field_name"), F.col("field").alias("source_name"),
        F.col("jtype").alias("json_type"), "target_type", F.col("value").alias("value_text"), of("decimal", F.expr(NUMBER)).alias("value_num"),
        of("boolean", F.expr("try_cast(value as boolean)")).alias("value_bool"), of("json", F.coalesce("nested", quoted)).alias("value_json"),
    )


def failed_casts(table: DataFrame) -> DataFrame:
    """The values of :func:`unified` that their lineage's type could not hold: they are kept as text alone."""
    lost = F.when(F.col("target_type") == "decimal", F.col("value_num").isNull()).when(F.col("target_type") == "boolean", F.col("value_bool").isNull())
    return table.where(F.col("value_text").isNotNull() & lost).select(
        "source", "producer", "file_id", "field_name", "source_name", "json_type", "target_type", "value_text"
    )


def drift(source_sha256: DataFrame, summaries: DataFrame) -> DataFrame:
    """:func:`lifespan_rows` over both tables: leaves of the first, top-level keys of the second."""
    a = file_fields(source_sha256, "source_sha256", leaf_fields)
    b = file_fields(summaries, "summaries", top_fields)
    return lifespan_rows(a.unionByName(b))
