"""Problem 5 against a reader per source, and units found by links alone."""

import os
import re
from decimal import ROUND_HALF_UP, Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandframe.operators import units
from strandframe.plans import drift_queries as Q

SIZE = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 2**10, "mib": 2**20, "gib": 2**30,
        "kilobytes": 10**3, "megabytes": 10**6, "gigabytes": 10**9}
TIME = {"ms": 1, "s": 1000, "min": 60000, "milliseconds": 1, "seconds": 1000, "minutes": 60000}
PLAIN = {2: (1, 1, 1), 3: (None, 1024, 1024), 4: (1000, 1, 2**20), 10: (60000, 2**20, 2**30), 11: (100, 1000, 1000)}


def whole(x):
    return int(Decimal(x).to_integral_value(ROUND_HALF_UP))


def clock(t):
    days, _, rest = t.rpartition("-")
    parts = [Decimal(p) for p in rest.split(":")]
    return (int(days or 0) * 86400 + sum(p * 60**i for i, p in enumerate(reversed(parts)))) * 1000


def read(source, column, text, remark):
    text = (text or "").replace("\xa0", " ").strip()
    if text in ("", "-", "n/a"):
        return None
    is_time, at = column == "duration", {"duration": 0, "peak_rss": 1, "rchar": 2}[column]
    if is_time and source in (3, 6):
        return whole(clock(text))
    if is_time and source in (1, 7, 8):
        spans = re.findall(r"([\d.]+)\s*(hr|h|min|m|sec|s)", text.lower())
        return whole(sum(Decimal(n) * {"h": 3600000, "m": 60000, "s": 1000}[u[0]] for n, u in spans))
    if source in PLAIN:
        return whole(Decimal(text) * PLAIN[source][at])
    number, unit = re.fullmatch(r"([\d.,]+)\s*([A-Za-z]*)", text).groups()
    number = number.replace(",", "." if source == 5 else "")
    if source == 6:
        unit += "iB"
    if not unit:
        words = {"duration": "times|duration", "peak_rss": "memory|rss", "rchar": "rchar|characters"}[column]
        unit = next(c for c in remark.split(";") if re.search(words, c)).split()[-1]
    return whole(Decimal(number) * (TIME if is_time else SIZE)[unit.lower()])


@pytest.fixture(scope="module")
def rows(sf):
    return list({r["trace_id"]: r for r in pq.read_table(f"{sf}/historical_trace.parquet").to_pylist()}.values())


def test_every_value_of_the_table(spark, sf, rows):
    want = {(r["trace_id"], c, v) for r in rows for c in ("duration", "peak_rss", "rchar") if (v := read(r["source_id"], c, r[c], r["remark"])) is not None}
    got = [tuple(r) for r in Q.p5_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


TRACE = ("trace_id bigint, source_id int, task_name string, duration string, realtime string, peak_rss string, rchar string, remark string, "
         "received_at timestamp, unit string")
SOURCES = "source_id int, host string, collector string, unit_note string"


def test_an_unwritten_unit_is_found_by_links(spark):
    data = [(i, 1, f"t{i}", f"{i + 1} s", None, f"{i + 1} MB", None, None, None, "x") for i in range(30)]
    data += [(100 + i, 2, f"t{i}", str((i + 1) * 1000 + i % 3), None, str((i + 1) * 1000), None, None, None, "x") for i in range(30)]
    trace, sources = spark.createDataFrame(data, TRACE), spark.createDataFrame([(1, "a", "b", None), (2, "a", "b", "no idea")], SOURCES)
    scale = {(r.source_id, r.field_name): (int(r.factor), r.method) for r in units.scales(units.figures(trace, sources)).collect()}
    assert scale == {(1, "duration"): (1000, "written"), (2, "duration"): (1, "linked"), (1, "peak_rss"): (10**6, "written"), (2, "peak_rss"): (1000, "linked")}


def graded(spark, of):
    """Scales of two sources: 12 processes of 10 runs each, the second source's figures made from the first's by ``of``."""
    data = [(100 * s + k, s, f"p{k % 12} (S{k})", None, None, f"{y} MB" if s == 1 else str(y), None, None, None, "x")
            for k in range(120) for s, y in ((1, round(2.0 ** (k % 12) * (1 + k / 5000), 4)), (2, of(2.0 ** (k % 12) * (1 + k / 5000), k)))]
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    trace, sources = spark.createDataFrame(data, TRACE), spark.createDataFrame([], SOURCES)
    read = units.figures(trace, sources)
    return {r.source_id: r for r in units.scales(read).collect()}, units.links(read).collect()


def test_an_offset_or_mixed_units_are_no_conversion(spark):
    scale, _ = graded(spark, lambda x, k: round(x * 1000, 3))
    assert (scale[2].method, int(scale[2].factor)) == ("linked", 1000)
    scale, links = graded(spark, lambda x, k: round(x * 1000 + 200_000, 3))
    assert scale[2].method == "unlinked" and scale[2].factor is None and links[0].offset > 0.5
    scale, links = graded(spark, lambda x, k: round(x * (1 if k // 12 % 2 else 1000), 6))
    assert scale[2].method == "unlinked" and not links[0].usable


def test_a_written_unit_that_the_links_dispute_stands(spark):
    data = [(1000 * s + k, s, f"p{k % 12}", f"{k % 12 + 1} {'ms' if s == 3 else 's'}", None, None, None, None, None, "x") for k in range(120) for s in (1, 2, 3)]
    scale = {r.source_id: r for r in units.scales(units.figures(spark.createDataFrame(data, TRACE), spark.createDataFrame([], SOURCES))).collect()}
    assert [(scale[s].method, int(scale[s].factor)) for s in (1, 2, 3)] == [("agreed", 1000), ("agreed", 1000), ("disputed", 1)]


def test_hidden_notes_are_found_again_by_the_graph(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    trace, sources = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("historical_trace", "trace_sources"))
    hidden = sources.withColumn("unit_note", F.when(~F.col("source_id").isin(*PLAIN), F.col("unit_note")))
    right = {(c, s): PLAIN[s][i] for s in PLAIN for c, i in (("duration", 0), ("realtime", 0), ("peak_rss", 1), ("rchar", 2)) if PLAIN[s][i]}
    rows = units.scales(units.figures(trace, hidden)).collect()
    linked = {(r.field_name, r.source_id): r for r in rows if r.method == "linked"}
    assert linked.keys() == right.keys() and all(r.method in ("linked", "agreed") for r in rows)
    assert all(int(linked[k].factor) == f for k, f in right.items() if k[0] in units.TIMES)
    # Figures that spread over many powers of two cannot tell 1,000 from 1,024; both are listed then.
    assert all(f in [int(c) for c in linked[k].candidates] and max(linked[k].factor / f, f / linked[k].factor) < 1.08 for k, f in right.items())


@pytest.mark.parametrize("text,remark,note,want", [
    ("1.5", "memory: GiB", None, 3 * 2**29), ("1,5 GB", None, "decimal comma here", 15 * 10**8), ("1,500 KB", None, "Commas group thousands", 1500000),
    ("2K", None, "K counts 1024: binary", 2048), ("2K", None, None, 2000), ("7", None, "memory in megabytes", 7 * 10**6), ("7 kib", "rss in GB", "memory bytes", 7168),
    ("n/a", None, None, None), ("none", None, "memory bytes", None), ("twelve", None, "memory bytes", None), ("3 parsecs", None, None, None),
])
def test_sizes(spark, text, remark, note, want):
    trace = spark.createDataFrame([(1, 1, None, None, None, text, None, remark, None, "x")], TRACE)
    got = units.common_units(trace, spark.createDataFrame([(1, "a", "b", note)], SOURCES)).collect()
    assert [r.amount for r in got] == ([] if want is None else [want])


def test_null_source_and_name(spark):
    rows = [(1, None, None, "2 s", None, "3", None, None, None, None), (2, 1, "t", "4 s", None, None, None, None, None, None), (None, 1, "t", "4 s", None, None, None, None, None, None)]
    got = units.common_units(spark.createDataFrame(rows, TRACE), spark.createDataFrame([(1, "a", "b", None), (None, "a", "b", "memory bytes")], SOURCES))
    assert {(r.trace_id, r.field_name, r.amount) for r in got.collect()} == {(1, "duration", 2000), (2, "duration", 4000)}


def test_empty(spark):
    assert units.common_units(spark.createDataFrame([], TRACE), spark.createDataFrame([], SOURCES)).count() == 0
