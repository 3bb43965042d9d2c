"""Deeply nested records as flat, linked tables (Dewey labelling).

A JSON text becomes rows, one per node, each with the ordinal path from the root as its
label. Cutting the last ordinal off gives the parent's label, so parent-child links need
no second look at the text. Nodes are told apart by schema path, wherever in a record
their part of it stands, and those of one kind form one table: files, runs or lanes, arms,
single elements, and the remaining scalar details.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.jsonwalk import dewey_rows

#: Objects of the given files whose keys are data, not schema.
KEYED = frozenset({"arms", "calls_by_direction", "log2_histogram"})

# Schema paths, matched at any depth.
RUN = r"(?:^|>)(?:runs|lanes)>\[\]$"
NAMED_ARM = r"(?:^|>)arms>(?:\{\}|\[\])"
SIDE = r"(?:^|>)(?:inner|direct)$"
ARM = rf"{NAMED_ARM}$|{SIDE}"
ARM_FIELD = rf"{NAMED_ARM}>(?:arm|requests)$"
ARM_NAME = rf"{NAMED_ARM}>arm$"
TIMING = rf"{NAMED_ARM}>(?:cpu20_s|gpu_wall_s)(?:>\[\](?:>s)?)?$"
CALLS = r"(?:^|>)(?:inner|direct)>calls_by_direction(?:>\[\](?:>calls)?|>\{\})?$"
CALL_DIR = r"(?:^|>)(?:inner|direct)>calls_by_direction>\[\]>dir$"
#: What the table of elements is made from, and the table of arms.
ELEMENT_NODES = "|".join((TIMING, NAMED_ARM + "$", ARM_NAME, CALLS, CALL_DIR))
ARM_NODES = "|".join((ARM, ARM_FIELD))
RUN_NAME = RUN[:-1] + ">(?:run|lane)$"
RUN_NODES = "|".join((RUN, RUN_NAME))
NODE = "file_id bigint, label string, path string, key string, kind string, value string"


def parent(label: Column) -> Column:
    """The label with its last ordinal cut off; null above the root, whose label is empty."""
    return F.when(label != "", F.regexp_replace(label, r"\.?[0-9]+$", ""))


def ordinal(label: Column, step: Column) -> Column:
    """The ordinal at a 0-based step of a label, null beyond its end."""
    return F.get(F.split(label, r"\."), step).try_cast("bigint")


def _cut(label: Column, steps: Column) -> Column:
    """The label of the ancestor that lies ``steps`` below the root."""
    return F.call_function("substring_index", label, F.lit("."), steps.cast("int"))


def _depth(steps: Column, *names: str) -> Column:
    """How many steps lead to the first of the named ones, 0 if none is on the way."""
    return F.coalesce(*[F.nullif(F.array_position(steps, name), F.lit(0).cast("bigint")) for name in names], F.lit(0).cast("bigint"))


def nodes(files: DataFrame, source: str, keyed: frozenset[str] = KEYED, keep: str | None = None) -> DataFrame:
    """One row per JSON node: source, file_id, label, parent_label, path, key, kind, value.

    Deliveries of one ``file_id`` count once (the latest by ``received_at``). Rows without id
    and unreadable payloads give no nodes. ``keep`` is a pattern of schema paths: other nodes
    are left out where they are found.
    """
    once = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(F.struct("received_at", "payload")).alias("f"))
    tree = once.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("f.payload").alias("payload")).mapInPandas(dewey_rows(keyed, keep), NODE)
    return tree.select(F.lit(source).alias("source"), "file_id", "label", parent(F.col("label")).alias("parent_label"), "path", "key", "kind", "value")


def run_label() -> Column:
    """The label of the enclosing entry of a ``runs`` or ``lanes`` array, null outside one."""
    steps = F.split("path", ">")
    deep = _depth(steps, "runs", "lanes")
    return F.when((deep > 0) & (F.get(steps, deep) == "[]"), _cut(F.col("label"), deep + 1))


def run_no() -> Column:
    """Position in the enclosing ``runs`` or ``lanes`` array, else 0."""
    return F.coalesce(F.regexp_extract(run_label(), r"([0-9]+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def files(all_nodes: DataFrame) -> DataFrame:
    """One row per file: source, file_id, node_id (the root's, empty), kind."""
    return all_nodes.where("label = ''").select("source", "file_id", F.col("label").alias("node_id"), "kind")


def runs(all_nodes: DataFrame) -> DataFrame:
    """One row per run or lane: source, file_id, node_id, parent_id, run_no, run_name.

    ``run_name`` is what the entry itself calls its ``run`` or ``lane``, null if it has none.
    """
    is_run = F.col("path").rlike(RUN)
    part = all_nodes.where(is_run | F.col("path").rlike(RUN_NAME))
    return part.groupBy("source", "file_id", run_label().alias("node_id")).agg(
        F.max(run_no()).alias("run_no"), F.max(F.when(~is_run, F.col("value"))).alias("run_name"), F.bool_or(is_run).alias("is_run")
    ).where("is_run").select("source", "file_id", "node_id", parent(parent(F.col("node_id"))).alias("parent_id"), "run_no", "run_name")


def arms(all_nodes: DataFrame) -> DataFrame:
    """One row per arm: source, file_id, arm_id, parent_id, run_no, arm, requests.

    Arms are the entries of ``arms`` and the objects ``inner`` and ``direct``. The name is the
    key or, where the arms are an array, the arm's own ``arm`` field (null if it has none). Children
    meet their arm by the truncated label; ``parent_id`` is the run or object that holds the arms.
    """
    path = F.col("path")
    is_arm, is_name = path.rlike(ARM) & (F.col("kind") == "object"), path.rlike(ARM_NAME)
    arm_label = F.when(is_arm, F.col("label")).when(path.rlike(ARM_FIELD), F.col("parent_label"))
    part = all_nodes.withColumn("arm_id", arm_label).where(F.col("arm_id").isNotNull())
    held = F.max(F.when(is_arm & ~path.rlike(SIDE), parent(parent(F.col("label")))).when(is_arm, F.col("parent_label")))
    return part.groupBy("source", "file_id", "arm_id").agg(
        F.max(run_no()).alias("run_no"), held.alias("parent_id"), F.bool_or(is_arm).alias("is_arm"),
        F.coalesce(F.max(F.when(is_arm, F.col("key"))), F.max(F.when(is_name, F.col("value")))).alias("arm"),
        F.max(F.when(path.rlike(ARM_FIELD) & ~is_name, F.expr("try_cast(value as bigint)"))).alias("requests"),
    ).where("is_arm").select("source", "file_id", "arm_id", "parent_id", "run_no", "arm", "requests")


def elements(all_nodes: DataFrame) -> DataFrame:
    """One row per non-null element of cpu20_s, gpu_wall_s and calls_by_direction, in every layout.

    Columns: source, file_id, run_no, arm, field_name, elem_no, amount, node_id, arm_id.
    A bare scalar is element 0, nulls keep their position, a direction object is numbered
    by its ``dir``. Amounts are nanoseconds (rounded half up) and counts; text that is no
    number gives no row.
    """
    path, label = F.col("path"), F.col("label")
    is_time, is_arm, is_arm_name = path.rlike(TIMING), path.rlike(NAMED_ARM + "$"), path.rlike(ARM_NAME)
    is_calls, is_dir = path.rlike(CALLS), path.rlike(CALL_DIR)
    steps = F.split(path, ">")
    # How deep the arm lies: an entry under ``arms``, or the object that holds the calls.
    deep = F.when(is_calls | is_dir, _depth(steps, "calls_by_direction") - 1).otherwise(_depth(steps, "arms") + 1)
    # Nodes that name others meet them at a truncated label; a group lies within one file.
    anchor = F.when(is_time | is_arm | is_arm_name, _cut(label, deep)).when(path.endswith(">calls") | is_dir, F.col("parent_label")).otherwise(label)
    name = F.when(is_arm, F.col("key")).when(is_arm_name | is_dir, F.col("value"))
    kept = all_nodes.where(path.rlike(ELEMENT_NODES)).select(
        "source", "file_id", "label", "path", "kind", "value", "key", anchor.alias("anchor"), name.alias("name"),
        deep.alias("deep"), is_time.alias("is_time"), (is_time | is_calls).alias("is_value"),
    )
    group = Window.partitionBy("source", "file_id", "anchor")
    values = kept.withColumn("sibling", F.max("name").over(group)).where(
        F.col("is_value") & F.col("kind").isin("integer", "float", "string")
    )
    owner = F.when(F.col("is_time"), F.col("sibling")).otherwise(F.get(steps, F.col("deep") - 1))
    direction = F.when(path.endswith(">{}"), F.col("key")).when(path.endswith(">calls"), F.col("sibling"))
    number = F.expr("try_cast(replace(trim(value), ',', '') as decimal(28,10))")
    amount = F.round(F.when(F.col("is_time"), number * F.lit(1_000_000_000)).otherwise(number), 0)
    return values.select(
        "source", "file_id", run_no().alias("run_no"), F.coalesce(owner, F.lit("")).alias("arm"),
        F.get(steps, F.col("deep")).alias("field_name"),
        F.coalesce(direction.try_cast("bigint"), ordinal(label, F.col("deep") + 1), F.lit(0).cast("bigint")).alias("elem_no"),
        amount.try_cast("bigint").alias("amount"), F.col("label").alias("node_id"), _cut(label, F.col("deep")).alias("arm_id"),
    ).where(F.col("amount").isNotNull())


def details(all_nodes: DataFrame) -> DataFrame:
    """One row per non-null scalar that is no element: source, file_id, node_id, parent_id, run_no, path, key, value.

    Overlap rows, distributions, histograms and the fields of files, runs and arms: with
    :func:`elements` every value of a file is in a table, under its schema path and its parent.
    """
    path = F.col("path")
    return all_nodes.where(F.col("value").isNotNull() & ~path.rlike(TIMING) & ~path.rlike(CALLS)).select(
        "source", "file_id", F.col("label").alias("node_id"), F.col("parent_label").alias("parent_id"), run_no().alias("run_no"), "path", "key", "value"
    )
