"""Problem 4: sketches against exact ranks, merging, deleting, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import percentiles as P

RNG = np.random.default_rng(4)
SAMPLES = {
    "lognormal": RNG.lognormal(-3, 1.5, 4000), "two": np.concatenate([RNG.normal(0.1, 0.005, 3000), RNG.normal(2.0, 0.1, 900)]),
    "signed": RNG.normal(0, 50, 3000), "ties": np.repeat([0.0, 1.0, 8.0], [500, 300, 200]).astype(float),
}


def frame(spark, groups):
    rows = [(g, i % 3, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, day int, value double")


def test_ranks_and_merging(spark):
    df = frame(spark, SAMPLES)
    at = [0.01, 0.25, 0.5, 0.9, 0.99]
    by_day = P.sketches(df, ["g", "day"])
    for sketch in (P.sketches(df, ["g"]), P.merged(by_day, ["g"])):
        for r in P.quantiles(sketch, ["g"], at).collect():
            values = np.sort(SAMPLES[r.g])
            assert r.n_values == len(values)
            for q, found in zip(at, r.quantiles):
                low, high = np.searchsorted(values, found * (1 - 0.02 * np.sign(found))), np.searchsorted(values, found * (1 + 0.02 * np.sign(found)), "right")
                rank = int(q * (len(values) - 1))
                assert min(low, high) - 0.04 * len(values) <= rank <= max(low, high) + 0.04 * len(values)


def test_deletion_gives_the_sketch_of_the_rest(spark):
    df = frame(spark, {"a": SAMPLES["lognormal"]})
    kept, gone = df.where("day < 2"), df.where("day = 2")
    both = df.withColumn("w", F.lit(1)).unionByName(gone.withColumn("w", F.lit(-1)))
    cells = lambda s: {tuple(r) for r in s.collect()}
    assert cells(P.sketches(both, ["g"], weight="w")) == cells(P.sketches(kept, ["g"]))
    assert P.quantiles(P.sketches(both.where("day = 2"), ["g"], weight="w"), ["g"], [0.5]).count() == 0


def test_sketch_is_bounded(spark):
    df = spark.range(60000).select((F.col("id") * 1.7 + 1).alias("value"), F.lit(1).alias("g"))
    assert P.sketches(df, ["g"]).count() <= P.EXACT * P.WIDTH * P.DEPTH + 1023


@pytest.mark.parametrize("values,want", [([0.0], 0.0), ([float("nan"), None, 5.0], 5.0), ([float("inf")], None), ([-3.0, -3.0], -3.0), ([1e-300], 0.0)])
def test_odd_values(spark, values, want):
    df = spark.createDataFrame([(v, 9) for v in values], "value double, level int")
    r = P.quantiles(P.sketches(df.withColumn("k", F.lit(None).cast("string")), ["k"]), ["k"], [0.5]).first()
    assert r.k is None and (r.quantiles[0] > 1e22 if want is None else r.quantiles[0] == pytest.approx(want, rel=0.01))


def test_empty(spark):
    none = spark.createDataFrame([], "k string, value double")
    assert P.quantiles(P.sketches(none, ["k"]), ["k"], [0.5]).count() == 0


def test_clamped_values_are_counted(spark):
    rows = [("a", v) for v in (0.0, 1e-20, -1e-30, 1.0, 1e30, float("inf"), float("nan"), None)] + [("b", None)]
    got = P.clamped(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()
    assert [tuple(r) for r in got] == [("a", 6, 2, 2)]
