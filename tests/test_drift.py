"""Problems 1 and 2 against row-at-a-time versions."""

import json
from collections import defaultdict
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pyarrow.parquet as pq

from strandframe.operators import dewey, lifespans
from strandframe.plans import drift_queries as Q

FILES = "file_id bigint, evidence_dir string, host string, captured_at timestamp, received_at timestamp, payload string"


class I(str):
    pass


class Fl(str):
    pass


def read(text):
    return json.loads(text, parse_int=I, parse_float=Fl)


def jtype(v):
    for t, n in ((type(None), None), (bool, "boolean"), (I, "integer"), (Fl, "float"), (str, "string"), (list, "array")):
        if isinstance(v, t):
            return n
    return "object"


def text(v):
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, str) else None


def leaves(d, at=()):
    for k, v in d.items():
        if isinstance(v, dict):
            yield from leaves(v, (*at, k))
        else:
            yield ">".join((*at, k)), v


def brute_changes(rows, fields):
    series = defaultdict(dict)
    for r in rows:
        series[r["evidence_dir"]][r["file_id"]] = r
    out = set()
    for files in series.values():
        last, before = {}, None
        for r in sorted(files.values(), key=lambda r: r["captured_at"]):
            now = dict(fields(read(r["payload"])))
            if before is not None:
                new, gone = now.keys() - before.keys(), before.keys() - now.keys()
                origin = set()
                for f in new:
                    same = [g for g in gone if text(before[g]) is not None and text(before[g]) == text(now[f])]
                    if text(now[f]) is not None and len(same) == 1:
                        origin.add(same[0])
                        out.add((r["file_id"], f, "renamed"))
                        if jtype(now[f]) != last.get(same[0]):
                            out.add((r["file_id"], f, "retyped"))
                    else:
                        out.add((r["file_id"], f, "added"))
                out |= {(r["file_id"], g, "removed") for g in gone - origin}
                out |= {(r["file_id"], f, "retyped") for f in now.keys() & before.keys() if jtype(now[f]) and last.get(f) and jtype(now[f]) != last[f]}
            for f, v in now.items():
                last[f] = jtype(v) or last.get(f)
            before = now
    return out


def test_changes_on_the_tables(spark, sf):
    want = brute_changes(pq.read_table(f"{sf}/source_sha256.parquet").to_pylist(), leaves)
    want |= brute_changes(pq.read_table(f"{sf}/summaries.parquet").to_pylist(), dict.items)
    got = [tuple(r) for r in Q.p1_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def files(spark, *payloads, start=1):
    day = datetime(2031, 1, 1)
    rows = [(start + i, "d", "h", day.replace(day=i + 1), day, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, FILES)


def kinds(spark, *payloads):
    from strandframe.functions.jsonwalk import top_fields

    rows = lifespans.lifespan_rows(lifespans.file_fields(files(spark, *payloads), "t", top_fields))
    return {(r.file_id, r.field_name, r.change_kind) for r in lifespans.changes(rows).collect()}


def test_change_kinds(spark):
    assert kinds(spark, '{"a":1}', '{"b":1}', '{"b":1.0}', '{"b":null}', '{"b":"x"}') == {
        (2, "b", "renamed"), (3, "b", "retyped"), (5, "b", "retyped")}
    assert kinds(spark, '{"a":1,"c":1}', '{"b":1}') == {(2, "b", "added"), (2, "a", "removed"), (2, "c", "removed")}
    assert kinds(spark, '{"a":1}', '{"b":"1"}') == {(2, "b", "renamed"), (2, "b", "retyped")}
    assert kinds(spark, '{"a":null}', '{"b":null}') == {(2, "b", "added"), (2, "a", "removed")}
    assert kinds(spark, '{"a":[1]}', '{"a":{"x":1}}', "no json", None, "[1]", "{}") == {(2, "a", "retyped"), (6, "a", "removed")}


def test_empty_tables_and_extra_columns(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], FILES).withColumn("seq", F.lit(1)).withColumn("fields", F.lit("x"))
    assert lifespans.changes(lifespans.drift(none, none)).count() == 0
    assert dewey.elements(dewey.nodes(none, "summaries")).count() == 0


def test_lineage_names(spark):
    from strandframe.functions.jsonwalk import top_fields

    rows = lifespans.lifespan_rows(lifespans.file_fields(files(spark, '{"a":1}', '{"b":1}', '{"c":"1","d":"1,234"}'), "t", top_fields))
    out = lifespans.unified(rows, lifespans.alias_table(rows, lifespans.changes(rows)))
    got = {(r.file_id, r.field_name, r.source_name, float(r.value_num)) for r in out.collect()}
    assert got == {(1, "a", "a", 1.0), (2, "a", "b", 1.0), (3, "a", "c", 1.0), (3, "d", "d", 1234.0)}


def test_a_name_that_comes_back_is_another_lineage(spark):
    from strandframe.functions.jsonwalk import top_fields

    rows = lifespans.lifespan_rows(lifespans.file_fields(
        files(spark, '{"a":1}', '{"b":1}', '{"x":7}', '{"x":7,"b":2}', '{"x":7,"c":2}', '{"x":"seven"}'), "t", top_fields))
    aliases = lifespans.alias_table(rows, lifespans.changes(rows))
    assert {(r.field, r.island, r.canonical) for r in aliases.collect()} == {("a", 1, "a"), ("b", 1, "a"), ("x", 1, "x"), ("b", 2, "b"), ("c", 1, "b")}
    lost = lifespans.failed_casts(lifespans.unified(rows, aliases)).collect()
    assert [(r.file_id, r.field_name, r.value_text) for r in lost] == [(6, "x", "seven")]


def test_unified_keeps_nested_values_and_casts_by_lineage(spark):
    from strandframe.functions.jsonwalk import top_fields

    rows = lifespans.lifespan_rows(lifespans.file_fields(files(
        spark, '{"a":"1,234","j":[1.50,{"k":null,"é":"\\"x"}],"s":"12","b":true}', '{"z":1234.0,"a":5,"j":"q\\"","s":"x9","b":false}',
        '{"a":"n/a","j":{"x":[]},"s":null,"b":null}'), "t", top_fields))
    out = lifespans.unified(rows, lifespans.alias_table(rows, lifespans.changes(rows))).collect()
    got = {(r.seq, r.field_name): r for r in out}
    assert len(out) == len(got) == 13 and {r.producer for r in out} == {"d"}
    assert {(r.field_name, r.target_type) for r in out} == {("a", "decimal"), ("j", "json"), ("s", "string"), ("b", "boolean"), ("z", "decimal")}
    assert [got[i, "a"].value_num for i in (1, 2, 3)] == [1234, 5, None] and got[3, "a"].value_text == "n/a"
    assert "1.50" in got[1, "j"].value_json and json.loads(got[1, "j"].value_json) == [1.5, {"k": None, "é": '"x'}]
    assert json.loads(got[2, "j"].value_json) == 'q"' and json.loads(got[3, "j"].value_json) == {"x": []}
    assert got[1, "s"].value_num is None and got[1, "s"].value_text == "12" and (got[1, "b"].value_bool, got[2, "b"].value_bool) == (True, False)


def test_unified_loses_no_value_of_the_tables(spark, sf):
    out = Q.p1_unified(spark, sf)
    lost = out.where("json_type <> 'null' AND value_text IS NULL AND value_json IS NULL")
    assert {"producer", "seq", "target_type"} <= set(out.columns) and lost.count() == 0


def brute_elements(summaries, counters):
    """Looks for the names wherever they stand in a record, without any list of layouts."""
    out = set()

    def num(v, scale):
        return int((Decimal(v.replace(",", "")) * scale).to_integral_value(ROUND_HALF_UP))

    def timings(file_id, run, arm, body):
        for f in ("cpu20_s", "gpu_wall_s"):
            v = body.get(f)
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                x = x["s"] if isinstance(x, dict) else x
                if x is not None:
                    out.add((file_id, run, arm, f, i, num(x, 10**9)))

    def calls(file_id, run, arm, v):
        if isinstance(v, dict):
            pairs = [(int(k), x) for k, x in v.items()]
        else:
            pairs = [(int(x["dir"]), x["calls"]) if isinstance(x, dict) else (i, x) for i, x in enumerate(v or [])]
        out.update((file_id, run, arm, "calls_by_direction", i, num(x, 1)) for i, x in pairs if x is not None)

    def look(file_id, v, run, name):
        if isinstance(v, list):
            for i, x in enumerate(v):
                look(file_id, x, i if name in ("runs", "lanes") else run, None)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k == "calls_by_direction":
                    calls(file_id, run, name, x)
                elif k == "arms":
                    for arm, body in x.items() if isinstance(x, dict) else [(y["arm"], y) for y in x or []]:
                        timings(file_id, run, arm, body)
                else:
                    look(file_id, x, run, k)

    for table in (summaries, counters):
        for r in {r["file_id"]: r for r in table}.values():
            look(r["file_id"], read(r["payload"]), 0, None)
    return out


def test_every_path_of_the_measurements_is_claimed(spark, sf):
    nodes = Q._nodes(spark, sf).where("value IS NOT NULL AND kind <> 'boolean'")
    named = nodes.where("path RLIKE '(^|>)(calls_by_direction|cpu20_s|gpu_wall_s)(>|$)' AND path NOT LIKE '%overlap_rows%'")
    paths = {r.path for r in named.select("path").distinct().collect()}
    claimed = {r.path for r in nodes.where(f"path RLIKE r'{dewey.TIMING}' OR path RLIKE r'{dewey.CALLS}'").select("path").distinct().collect()}
    assert {p for p in paths - claimed if not p.endswith((">dir", ">repeat"))} == set()
    assert any(p.startswith("split>") for p in claimed)


def test_every_scalar_is_in_a_table_and_every_parent_exists(spark, sf):
    nodes = Q._nodes(spark, sf).cache()
    scalars = nodes.where("value IS NOT NULL AND kind <> 'null'").count()
    assert dewey.elements(nodes).count() + dewey.details(nodes).count() == scalars
    ids = {(r.source, r.file_id, r.label) for r in nodes.collect()}
    for part in (dewey.runs(nodes), dewey.arms(nodes), dewey.details(nodes), dewey.elements(nodes).withColumnRenamed("arm_id", "parent_id")):
        assert all((r.source, r.file_id, r.parent_id) in ids for r in part.collect())


def test_elements_on_the_tables(spark, sf):
    want = brute_elements(*(pq.read_table(f"{sf}/{t}.parquet").to_pylist() for t in ("summaries", "split_counters")))
    got = [tuple(r) for r in Q.p2_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_labels_link_to_parents(spark):
    tree = dewey.nodes(files(spark, '{"runs":[{"arms":[{"arm":"x","requests":7,"cpu20_s":[1.5,null,{"repeat":9,"s":2e-9}]}]}]}'), "summaries")
    got = {(r.run_no, r.arm, r.field_name, r.elem_no, r.amount, r.arm_id) for r in dewey.elements(tree).collect()}
    assert got == {(0, "x", "cpu20_s", 0, 1_500_000_000, "0.0.0.0"), (0, "x", "cpu20_s", 2, 2, "0.0.0.0")}
    assert [tuple(r)[2:] for r in dewey.arms(tree).collect()] == [("0.0.0.0", "0.0", 0, "x", 7)]
    assert [tuple(r)[2:] for r in dewey.runs(tree).collect()] == [("0.0", "", 0, None)]
    ids = {r.label for r in tree.collect()}
    assert all(r.parent_label in ids for r in tree.collect() if r.path)


def test_layouts_at_any_depth(spark):
    deep = files(
        spark, '{"x":{"split":{"inner":{"calls_by_direction":[1,null,3]},"direct":{"calls_by_direction":{"2":"1,000"}}}}}',
        '{"lanes":[{"a>b":{"inner":{"calls_by_direction":[{"dir":3,"calls":7}]}}},{"inner":null}]}', '[' * 600 + ']' * 600, '{"arms":{"y":{"cpu20_s":"x"}}}', '{"arms":null,"runs":{}}',
    )
    tree = dewey.nodes(deep, "split_counters")
    got = {(r.file_id, r.run_no, r.arm, r.elem_no, r.amount, r.arm_id) for r in dewey.elements(tree).collect()}
    assert got == {(1, 0, "inner", 0, 1, "0.0.0"), (1, 0, "inner", 2, 3, "0.0.0"), (1, 0, "direct", 2, 1000, "0.0.1"), (2, 0, "inner", 3, 7, "0.0.0.0")}
    assert {(r.file_id, r.run_no, r.run_name) for r in dewey.runs(tree).collect()} == {(2, 0, None), (2, 1, None)}
    kept = dewey.elements(dewey.nodes(deep, "split_counters", keep=dewey.ELEMENT_NODES))
    assert {(r.file_id, r.node_id) for r in kept.collect()} == {(r.file_id, r.node_id) for r in dewey.elements(tree).collect()}
