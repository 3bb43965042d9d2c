"""Registered queries against their SQL twins on the smallest tables, and the registry itself."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

CHECKED = [
    "flagstat_post", "idxstats", "bam_stat", "markdup_metrics", "coverage_sweep", "region_query", "gene_counts", "dup_matrix", "region_bases",
    "read_distribution", "junction_annotation", "inner_distance", "pos_dup_hist", "quantile_lower", "work_attribution", "bounded_capture", "p3_found",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(got.fetchall(), columns) == canonical([tuple(r) for r in df.collect()], df.columns)


def test_registry():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert {f"p{n}_found" for n in (1, 2, 3, 5)} <= set(known)


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).limit(1).count() == 1


def test_no_cross_joins_in_plans(spark, sf):
    for name in ("gene_counts", "markdup_metrics", "p3_found", "region_query"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_marked_table_is_made_again_when_its_files_are_gone(spark, sf):
    import shutil

    from strandframe.plans import alignment_queries as Q

    first = Q._marked(spark, sf)
    assert Q._marked(spark, sf) is first
    shutil.rmtree(os.path.dirname(first.inputFiles()[0].removeprefix("file://")))
    again = Q._marked(spark, sf)
    assert again is not first and again.count() == Q._aln(spark, sf).count()


def test_the_chain_writes_every_report(spark, sf, tmp_path):
    from strandframe.plans import alignment_queries as Q

    paths = Q.write_chain(spark, sf, str(tmp_path))
    rows = {r.report: r.n_rows for r in entry.queries()["chain"](spark, sf).collect()}
    assert rows == {name: spark.read.parquet(path).count() for name, path in paths.items()} and rows["inner_distance"] == 100
