"""Percentiles of very large columns from mergeable sketches (dyadic Count-sketches).

A value is encoded as a 16-bit number whose order is that of the values and whose steps are
0.27 % wide. For each binary resolution of that number (drop the lowest 0, 1, 2 ... bits) a
group keeps a Count-sketch of its dyadic intervals: ``DEPTH`` rows of ``WIDTH`` signed counters;
resolutions with no more intervals than that keep exact counts. Counters add up, so sketches
of days or partitions merge by addition, and counting rows with weight -1 takes values
back. A rank is inverted by descending from the coarsest resolution: the estimated count of
the lower half tells which half holds the rank.

A sketch has at most 7 * 384 + 1,023 counters, whatever the number of values. Each level's
estimate errs by the order of ``sqrt(sum of squared counts / WIDTH)`` of the intervals that share its counters; over 200,000 values
that fill the codes densely the worst error of a rank was 0.55 % of their number, and it is far less for the few
distinct codes of timings. The error of a value is half a step; :func:`clamped` counts values outside the codes' range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
HALF = 1 << (BITS - 1)
STEPS = 256
LOWEST = 2.0**-50
WIDTH, DEPTH = 128, 3
#: Resolutions from this one up have at most 512 intervals and are counted exactly.
EXACT = BITS - 9
PRIME = 2_147_483_647


def encode(value: Column) -> Column:
    """The ordered 16-bit code of a double: sign, then its logarithm in steps of 1/256 of a doubling.

    Zero and magnitudes under 2^-50 share one code; magnitudes over 2^77, infinities
    included, share the last one of their sign. Null and NaN give null.
    """
    size = F.least(F.floor((F.log2(F.abs(value)) + 50) * STEPS) + 1, F.lit(HALF - 1))
    size = F.when(F.abs(value) < LOWEST, F.lit(0)).when(F.abs(value) > 2.0**77, F.lit(HALF - 1)).otherwise(size)
    return F.when(value.isNull() | F.isnan(value), None).otherwise(F.lit(HALF) + F.when(value < 0, -size).otherwise(size)).cast("int")


def clamped(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys``, n_values, n_small, n_large: how many values share the code of zero without being zero, or the last code of their sign."""
    v = F.abs(F.col(value).cast("double"))
    return values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if((v > 0) & (v < LOWEST)).alias("n_small"), F.count_if(v > 2.0**77).alias("n_large")
    )


def decode(code: np.ndarray) -> np.ndarray:
    """The middle of a code's step."""
    size = np.abs(code - HALF)
    value = np.where(size == 0, 0.0, np.exp2((size - 0.5) / STEPS - 50))
    return np.where(code < HALF, -value, value)


def _hash(level, node, row, use: int):
    """A pairwise independent hash of a node for each level and row; the same on columns and arrays."""
    k = (level * DEPTH + row) * 2 + use + 1
    return (node * (k * 2_654_435_761 % (PRIME - 1) + 1) + k * 40_503_577) % PRIME


def sketches(values: DataFrame, keys: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """One row per group and counter: ``keys``, level, row, slot, n.

    ``weight`` names a column of counts, negative to delete. Rows with a null or NaN value are no
    values; null keys form a group of their own. Values are counted by code first, so no
    more than the distinct codes of a group are spread over its counters.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    coded = values.select(*keys, encode(F.col(value).cast("double")).alias("code"), w.alias("w")).where("code IS NOT NULL")
    counted = coded.groupBy(*keys, "code").agg(F.sum("w").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("level")
    nodes = counted.select(*keys, level, "code", "n").withColumn("node", F.expr("shiftright(code, level)"))
    exact = F.col("level") >= EXACT
    rows = F.when(exact, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(DEPTH - 1)))
    spread = nodes.select(*keys, "level", "node", "n", F.explode(rows).alias("row"))
    place = [F.col(c).cast("bigint") for c in ("level", "node", "row")]
    slot = F.when(exact, F.col("node")).otherwise(_hash(*place, 0) % WIDTH).cast("int")
    signed = F.when(~exact & (_hash(*place, 1) % 2 == 1), -F.col("n")).otherwise(F.col("n"))
    cells = spread.select(*keys, "level", "row", slot.alias("slot"), signed.alias("n"))
    return cells.groupBy(*keys, "level", "row", "slot").agg(F.sum("n").alias("n")).where("n != 0")


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up over all but ``keys``: those of several days, sources or partitions."""
    return sketch.groupBy(*keys, "level", "row", "slot").agg(F.sum("n").alias("n")).where("n != 0")


def quantiles(sketch: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """``keys``, n_values and ``quantiles`` (an array, one entry per entry of ``at``) of every group.

    The rank of q is ``floor(q * (n - 1))``, the lower nearest. A group is gathered as the
    counters of its sketch, whose number is bounded, never as its values. Groups whose
    counts cancel out have no row.
    """
    rows_of = np.arange(DEPTH)

    def invert(level, row, slot, n) -> tuple[int, list[float]]:
        level, row, slot, n = (np.asarray(x) for x in (level, row, slot, n))
        exact = level >= EXACT
        counts = {(int(a), int(b)): int(c) for a, b, c in zip(level[exact], slot[exact], n[exact])}
        total = counts.get((BITS, 0), 0)
        grid = np.zeros((EXACT, DEPTH, WIDTH), dtype=np.int64)
        grid[level[~exact], row[~exact], slot[~exact]] = n[~exact]

        def count(lv: int, node: int) -> float:
            if lv >= EXACT:
                return counts.get((lv, node), 0)
            each = grid[lv, rows_of, _hash(lv, node, rows_of, 0) % WIDTH] * (1 - 2 * (_hash(lv, node, rows_of, 1) % 2))
            return float(np.median(each))

        out = []
        for q in at:
            rank, node, mass = int(q * (total - 1)), 0, float(total)
            for lv in range(BITS - 1, -1, -1):
                low, high = max(0.0, count(lv, 2 * node)), max(0.0, count(lv, 2 * node + 1))
                # The halves share what their parent was found to hold.
                share = low / (low + high) * mass if low + high else mass / 2
                share = low if lv >= EXACT else share
                if rank < share:
                    node, mass = 2 * node, share
                else:
                    node, mass, rank = 2 * node + 1, mass - share, rank - share
            out.append(float(decode(np.array([node]))[0]))
        return total, out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [invert(*x) for x in zip(batch["level"], batch["row"], batch["slot"], batch["n"])]
            out = batch[keys].copy()
            out["n_values"] = [t for t, _ in found]
            out["quantiles"] = [v for _, v in found]
            yield out[out["n_values"] > 0]

    fields = sketch.select(*keys).schema
    gathered = sketch.groupBy(*keys).agg(F.collect_list(F.struct("level", "row", "slot", "n")).alias("c")).select(
        *keys, *[F.col(f"c.{x}").alias(x) for x in ("level", "row", "slot", "n")]
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_values bigint, quantiles array<double>"
    return gathered.mapInPandas(run, schema)
