"""Problem 3: per-place results under skew, nulls and repeated deliveries."""

from datetime import datetime

from pyspark.sql import functions as F

from strandframe.operators import heavy_keys

COLUMNS = "rec_idx bigint, qname string, flag int, tid int, pos int, mapq int, ref_len int, loaded_at timestamp, salt int"
DAY = datetime(2031, 1, 6)


def test_counts_names_and_best(spark):
    rows = [(i, f"q{i // 2}", 0, 1, 5, i % 60, 40, DAY, 0) for i in range(500)]
    rows += rows[:50]
    rows += [(1000, None, 4, None, None, None, None, DAY, 0), (1001, "n", None, -1, -1, 255, 1, None, 0), (None, "z", 0, 1, 5, 60, 1, DAY, 0)]
    rows += [(2000, "a", 0, 2, 7, 255, 10, DAY, 0), (2001, "a", 4, 2, 7, 3, 10, DAY, 0)]
    for parts in (1, 7):
        got = heavy_keys.place_results(spark.createDataFrame(rows, COLUMNS).repartition(parts), salts=8)
        assert {tuple(r) for r in got.collect()} == {
            (1, 5, 500, 500, 250, 59, 59), (-1, -1, 2, 0, 1, 1001, -1), (2, 7, 2, 1, 1, 2001, 3)}


def test_ties_go_to_the_lowest_record(spark):
    rows = [(i, "q", 0, 0, 0, 9, 9, DAY, 0) for i in (7, 3, 5)]
    got = heavy_keys.place_results(spark.createDataFrame(rows, COLUMNS)).first()
    assert (got.n_records, got.n_names, got.best_rec_idx) == (3, 1, 3)


def test_empty(spark):
    none = heavy_keys.place_results(spark.createDataFrame([], COLUMNS))
    assert none.count() == 0 and heavy_keys.crowded_places(none).count() == 0


def test_heavy_list_is_bounded_and_salts_spread(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").alias("name"))
    assert [r.k for r in heavy_keys.heavy_keys(df, ["k"], 0.1).collect()] == [0]
    sizes = heavy_keys.salted(df, ["k"], F.col("name"), 0.1, 16).where("k = 0").groupBy("salt").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 150
