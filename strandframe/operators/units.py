"""One unit for quantities that many sources recorded in their own.

A figure is read with the unit beside it, else that of the row's remark, else that of the
collector's note. Figures of one source, column and unit mark form a *dialect*. The same
processes run in every source; per process the sources are linked to the one that recorded it most,
the median ratio of each link over all processes gives a robust scale with its uncertainty, a line
through small and large processes its offset, and the scales run through this graph from the dialects whose
unit is written down to every other dialect, where they snap to the known conversions that
the uncertainty allows. A written unit picks among these and stands even where it is not one of them (it is listed as disputed);
without a written unit the nearest one is taken.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from strandframe.session import written

TIMES, SIZES = ("duration", "realtime"), ("peak_rss", "rchar")

# Factors to milliseconds and bytes.
MILLISECONDS = {"ms": "1", "ds": "100", "s": "1000", "min": "60000", "h": "3600000", "d": "86400000"}
BYTES = {
    "b": "1", "kb": "1000", "mb": "1000000", "gb": "1000000000", "tb": "1000000000000",
    "kib": "1024", "mib": "1048576", "gib": "1073741824", "tib": "1099511627776",
}

# Spellings of units.
TIME_WORDS = {
    "ms": "ms msec msecs milli millis millisecond milliseconds", "ds": "decisecond deciseconds",
    "s": "s sec secs second seconds", "min": "m min mins minute minutes", "h": "h hr hrs hour hours", "d": "d day days",
}
SIZE_WORDS = {
    "b": "b byte bytes", "kb": "k kb kilobyte kilobytes", "mb": "m mb megabyte megabytes", "gb": "g gb gigabyte gigabytes",
    "tb": "t tb terabyte terabytes", "kib": "kib kibibyte kibibytes", "mib": "mib mebibyte mebibytes",
    "gib": "gib gibibyte gibibytes", "tib": "tib tebibyte tebibytes",
}
# Phrases for units that notes use.
PHRASES = {"tenth of a second": "ds", "tenths of a second": "ds", "1000 bytes": "kb", "1024 bytes": "kib"}
# Words by which remarks and notes speak of a column.
COLUMN_WORDS = {
    "duration": r"duration|times?|elapsed", "realtime": r"realtime|times?|elapsed",
    "peak_rss": r"peak_rss|rss|resident set|memory|sizes?", "rchar": r"rchar|characters read|read volume|sizes?",
}
_CODES = {
    **{f"time:{w}": code for code, words in TIME_WORDS.items() for w in words.split()},
    **{f"size:{w}": code for code, words in SIZE_WORDS.items() for w in words.split()},
}
_BINARY = {"kb": "kib", "mb": "mib", "gb": "gib", "tb": "tib"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _spelt(column: str, least: int = 1) -> str:
    words = TIME_WORDS if column in TIMES else SIZE_WORDS
    return "|".join(sorted((w for ws in words.values() for w in ws.split() if len(w) >= least), key=len, reverse=True))


def note_facts(note: str | None) -> list[tuple[str, str]]:
    """What a collector's note says: (column, unit) pairs, and ('*', fact) for its habits.

    The facts are ``decimal_comma``, ``group_comma`` and ``binary`` (K, M and G count 1024).
    """
    import re

    facts: list[tuple[str, str]] = []
    low = (note or "").lower()
    if re.search(r"decimal comma", low):
        facts.append(("*", "decimal_comma"))
    elif re.search(r"commas? (?:group|separate)", low):
        facts.append(("*", "group_comma"))
    if re.search(r"\bbinary\b|\(1024\)", low):
        facts.append(("*", "binary"))
    for clause in re.split(r"[.;,](?:\s|$)", low):
        for column, words in COLUMN_WORDS.items():
            if not re.search(rf"\b(?:{words})\b", clause):
                continue
            kind = "time" if column in TIMES else "size"
            phrase = next((code for p, code in PHRASES.items() if p in clause and (code == "ds") == (kind == "time")), None)
            named = re.findall(rf"(?<![\w\[:])(?:{_spelt(column, 2)})(?![\w\]:])", clause)
            unit = phrase or (_CODES[f"{kind}:{named[-1]}"] if named else None)
            if unit:
                facts.append((column, unit))
    return facts


_FACTS = ArrayType(StructType([StructField("field", StringType()), StructField("fact", StringType())]))


@F.pandas_udf(_FACTS)
def _facts(notes: pd.Series) -> pd.Series:
    return notes.map(note_facts)


def _said(column: str) -> Column:
    """The unit a row's remark gives for a column: clauses are parted by semicolons."""
    token = F.regexp_extract(
        F.lower("remark"), rf"(?:^|;)[^;]*\b(?:{COLUMN_WORDS[column]})\b[^;]*?(?<!\w)({_spelt(column, 2)})(?!\w)", 1
    )
    kind = "time:" if column in TIMES else "size:"
    return F.when(F.col("remark").isNotNull(), _lookup(_CODES, F.concat(F.lit(kind), token)))


def _number(digits: Column) -> Column:
    """A figure's digits as a decimal, by the source's habit with commas or else by their look."""
    grouped = F.regexp_replace(digits, ",", "")
    pointed = F.regexp_replace(F.regexp_replace(digits, r"[.](?=[0-9]{3}(?:[^0-9]|$))", ""), ",", ".")
    text = (
        F.when(~digits.contains(","), digits)
        .when(F.col("comma") == "group_comma", grouped)
        .when(F.col("comma") == "decimal_comma", pointed)
        .when(digits.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+(?:[.][0-9]*)?$"), grouped)
        .otherwise(pointed)
    )
    return text.try_cast("decimal(28,9)")


def figures(trace: DataFrame, sources: DataFrame, columns: tuple[str, ...] = (*TIMES, *SIZES), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per present value: trace_id, source_id, entity, field_name, x, mark, unit, and the columns of the trace to ``keep``.

    Deliveries of one ``trace_id`` count once, the latest by ``received_at`` stands. Empty
    text, null and marks for "none" (-, n/a, none, null, nan) are no values, nor is text
    without a figure. A null source is one of its own (-1). ``columns`` says which to read. ``x`` is the figure; for clocks and compound durations it is in
    milliseconds already. ``mark`` says where the unit comes from: own, remark, note or none.
    """
    row = F.struct("received_at", "source_id", "task_name", "remark", *columns, *keep)
    # Parted first: the rows are not reduced by a partial aggregate, which would sort them once more.
    parted = trace.where(F.col("trace_id").isNotNull()).select("trace_id", row.alias("t")).repartition("trace_id")
    once = parted.groupBy("trace_id").agg(F.max("t").alias("t")).select("trace_id", "t.*")
    each = [
        F.struct(
            F.lit(c).alias("field_name"), F.lit("time:" if c in TIMES else "size:").alias("kind"),
            F.trim(F.regexp_replace(c, "[\u00a0\u202f]", " ")).alias("raw"), _said(c).alias("said"),
        )
        for c in columns
    ]
    long = once.select("trace_id", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.regexp_replace("task_name", r"\s+", " ").alias("entity"), *keep, F.inline(F.array(*each))).where(
        F.col("raw").isNotNull() & ~F.lower("raw").isin("", "-", "--", "n/a", "na", "none", "null", "nan", "\u2014")
    )
    # A handful of facts per source: Spark sees how many there are and picks the join.
    facts = sources.select("source_id", F.inline(_facts("unit_note")))
    habits = facts.where("field = '*'").groupBy("source_id").agg(
        F.max(F.when(F.col("fact").endswith("comma"), F.col("fact"))).alias("comma"), F.max(F.col("fact") == "binary").alias("binary")
    )
    notes = facts.where("field != '*'").groupBy("source_id", F.col("field").alias("field_name")).agg(F.min("fact").alias("note_unit"))
    rows = long.join(habits, "source_id", "left").join(notes, ["source_id", "field_name"], "left")

    simple = r"^([0-9][0-9.,\s']*)([A-Za-z]*)$"
    clock = r"^(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+(?:[.,]\d+)?)$"
    cut = rows.withColumns({
        "digits": F.regexp_replace(F.regexp_extract("raw", simple, 1), r"[\s']", ""),
        "code": _lookup(_CODES, F.concat("kind", F.lower(F.regexp_extract("raw", simple, 2)))),
        "parts": F.lower(F.when(F.col("raw").contains(":"), F.regexp_replace("raw", clock, "$1d $2h $3m $4s")).otherwise(F.col("raw"))),
    })

    def part(unit: str) -> Column:
        """Milliseconds of one part of a clock, an ISO duration or a compound such as ``1h 2m 3.5s``."""
        token = F.regexp_extract("parts", rf"([0-9][0-9.,]*)\s*(?:{TIME_WORDS[unit].replace(' ', '|')})(?![a-z])", 1)
        return F.coalesce(F.replace(token, F.lit(","), F.lit(".")).try_cast("decimal(20,6)"), F.lit(0)) * F.lit(int(MILLISECONDS[unit]))

    whole = part("d") + part("h") + part("min") + part("s") + part("ms")
    composed = (F.col("digits") == "") & (F.col("kind") == "time:") & F.col("parts").rlike("[0-9]\\s*[a-z]")
    own = F.when(F.col("binary"), F.coalesce(_lookup(_BINARY, F.col("code")), "code")).otherwise(F.col("code"))
    read = cut.select(
        "trace_id", "source_id", "entity", *keep, "field_name", "said", "note_unit", composed.alias("composed"), own.alias("own"),
        F.when(composed, whole.cast("decimal(28,9)")).otherwise(_number(F.col("digits"))).alias("x"),
    ).where(F.col("x").isNotNull())
    own = F.when(F.col("composed"), F.lit("ms")).otherwise(F.col("own"))
    return read.select(
        "trace_id", "source_id", "entity", *keep, "field_name", "x",
        F.when(own.isNotNull(), "own").when(F.col("said").isNotNull(), "remark").when(F.col("note_unit").isNotNull(), "note").otherwise("none").alias("mark"),
        F.coalesce(own, "said", "note_unit", F.lit("?")).alias("unit"),
    )


DIALECT = ["field_name", "source_id", "mark", "unit"]
CHANNEL = ["field_name", "source_id", "channel"]
#: Quartile distance (of logarithms) taken for fewer than four figures, whose own says nothing.
WIDE = 2.0
#: A channel whose quartiles lie this many times as far apart as its partner's mixes units and is not linked.
MIXED = 3.0
#: A link whose offset is more than this share of the typical figure is no conversion of units.
OFFSET = 0.5
#: Standard deviations within which a known conversion may be the estimated one, and the least distance in logarithms.
NEAR, LEAST_NEAR = 3.0, 0.005
#: The walk over the graph takes place on the driver: so many dialects at most, a number of sources, columns and spellings.
MOST_DIALECTS = 100_000
_FACTORS = {**{f: MILLISECONDS for f in TIMES}, **{f: BYTES for f in SIZES}}


def channels(read: DataFrame) -> DataFrame:
    """``read`` with ``channel`` and ``v``: what is compared between sources.

    Figures with a unit of their own or in the remark are one channel per source and column,
    ``stated``, with ``v`` in the common unit: such units are picked by the size of the figure, so
    the figures of one unit alone would not be comparable. All others are a channel per note, with ``v``
    as it stands.
    """
    factors = {f"{field}:{unit}": factor for field, table in _FACTORS.items() for unit, factor in table.items()}
    factor = _lookup(factors, F.concat_ws(":", "field_name", "unit")).try_cast("double")
    stated = F.col("mark").isin("own", "remark") & factor.isNotNull()
    x = F.col("x").cast("double")
    return read.withColumns({
        "channel": F.when(stated, "stated").otherwise(F.concat_ws(":", "mark", "unit")), "v": F.when(stated, x * factor).otherwise(x)
    })


def links(read: DataFrame) -> DataFrame:
    """Scale and offset between channels that hold the same processes: field_name, a, b, log_ratio, variance, offset, n, usable.

    The entities are the processes (a task's name without its sample), which run everywhere. Per
    process and channel the quartiles of the logarithms are taken; each channel is linked to the one
    that has most figures of the process, so a process gives no more links than it has channels.
    ``log_ratio`` is the median over processes of ln(b / a) and ``variance`` its uncertainty. ``offset`` is what
    a line through the processes with small and with large figures leaves at zero, as a share of b's
    typical figure; null where the processes are too alike to tell. Links whose offset or whose
    unequal spread says that they are no conversion are not ``usable``.
    """
    named = channels(read).where((F.col("v") > 0) & F.col("entity").isNotNull()).select(
        *CHANNEL, F.substring_index("entity", " (", 1).alias("entity"), F.log("v").alias("l")
    )
    mids = named.groupBy("entity", *CHANNEL).agg(F.percentile_approx("l", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]), 1000).alias("q"), F.count(F.lit(1)).alias("n"))
    wide = F.when(F.col("n") >= 4, F.col("q")[2] - F.col("q")[0]).otherwise(F.lit(WIDE))
    # The standard error of a median, by the quartiles of about normal logarithms.
    side = F.struct("source_id", "channel", F.col("q")[1].alias("mid"), wide.alias("wide"), (F.pow(0.93 * wide, 2) / F.col("n")).alias("var"), "n")
    seen = mids.select("field_name", "entity", side.alias("b"))
    hub = Window.partitionBy("field_name", "entity")
    pairs = seen.withColumn("a", F.max_by("b", F.struct("b.n", -F.col("b.source_id"), "b.channel")).over(hub)).where("b.source_id <> a.source_id OR b.channel <> a.channel").select(
        "field_name", F.struct("a.source_id", "a.channel").alias("a"), F.struct("b.source_id", "b.channel").alias("b"), F.col("a.mid").alias("la"), F.col("b.mid").alias("lb"),
        (F.col("a.var") + F.col("b.var")).alias("var"), ((F.col("a.n") >= 4) & (F.col("b.n") >= 4) & (F.col("b.wide") > MIXED * F.greatest("a.wide", F.lit(0.05)))).alias("mixed"),
    )
    key = ["field_name", "a", "b"]
    third = lambda q: F.percentile_approx("la", q, 1000)
    ratio = pairs.groupBy(*key).agg(
        F.percentile_approx(F.col("lb") - F.col("la"), 0.5, 1000).alias("log_ratio"), (1.57 * F.avg("var") / F.count(F.lit(1))).alias("variance"),
        F.count(F.lit(1)).alias("n"), F.avg(F.col("mixed").cast("double")).alias("mixed"), third(0.33).alias("lo"), third(0.67).alias("hi"),
    )
    # The line through the medians of the lower and of the upper third of the processes.
    mid = lambda c, when: F.percentile_approx(F.when(when, F.exp(c)), 0.5, 1000)
    low, high = F.col("la") <= F.col("lo"), F.col("la") >= F.col("hi")
    ends = pairs.join(ratio.select(*key, "lo", "hi", F.col("variance").alias("v")), key).groupBy(*key).agg(
        mid("la", low).alias("xa"), mid("la", high).alias("xb"), mid("lb", low).alias("ya"), mid("lb", high).alias("yb"), F.max("v").alias("v"), mid("lb", F.lit(True)).alias("typical"),
    )
    apart = F.log(F.col("xb") / F.col("xa")) > 10 * F.sqrt("v")
    line = ends.select(*key, F.when(apart & (F.col("xb") > F.col("xa")), (F.col("ya") - F.col("xa") * (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))) / F.col("typical")).alias("offset"))
    return ratio.join(line, key).select(
        *key, "log_ratio", "variance", "offset", "n", ((F.col("mixed") < 0.5) & (F.coalesce(F.abs("offset"), F.lit(0.0)) <= OFFSET)).alias("usable")
    )


def _estimates(known: dict[tuple, float], edges: dict[tuple, list[tuple]], skip: tuple | None = None) -> dict[tuple, tuple[float, float]]:
    """ln(factor) and variance of every channel reached from ``known`` but ``skip``, along the links of least variance."""
    import heapq

    done: dict[tuple, tuple[float, float]] = {}
    heap = [(0.0, i, c, v) for i, (c, v) in enumerate(sorted(known.items())) if c != skip]
    heapq.heapify(heap)
    count = len(known)
    while heap:
        variance, _, c, value = heapq.heappop(heap)
        if c in done:
            continue
        done[c] = (value, variance)
        for step, other, ratio in edges.get(c, ()):
            if other not in done:
                count += 1
                heapq.heappush(heap, (variance + step, count, other, value - ratio))
    return done


def scales(read: DataFrame) -> DataFrame:
    """One row per dialect: field_name, source_id, mark, unit, factor, estimate, candidates, method.

    Every dialect gets an estimate through the graph from the other sources, and the ``candidates``, the known
    conversions within its uncertainty (else the nearest one). A written unit picks its conversion
    (method ``agreed`` if that is a candidate, ``disputed`` if not, ``written`` if no link leads here); where no unit is written, the
    nearest candidate is taken (``linked``), or none (``unlinked``). The graph has one node per source, column
    and unit spelling, a number that does not grow with the rows; it is walked on the driver.
    """
    spark = read.sparkSession
    rows = channels(read).select(*DIALECT, "channel").distinct().limit(MOST_DIALECTS + 1).collect()
    if len(rows) > MOST_DIALECTS:
        raise ValueError(f"more than {MOST_DIALECTS} units and sources: units were not recognised")
    edges: dict[tuple, list[tuple]] = {}
    for r in links(read).where("usable").collect():
        a, b = (r.field_name, *r.a), (r.field_name, *r.b)
        edges.setdefault(a, []).append((r.variance, b, r.log_ratio))
        edges.setdefault(b, []).append((r.variance, a, -r.log_ratio))
    known = {}
    for r in rows:
        if r.unit in _FACTORS[r.field_name]:
            known[r.field_name, r.source_id, r.channel] = 0.0 if r.channel == "stated" else math.log(float(_FACTORS[r.field_name][r.unit]))
    far = _estimates(known, edges)
    near = {c: _estimates(known, edges, c).get(c) for c in known}
    out = []
    for r in sorted(rows):
        table, c = _FACTORS[r.field_name], (r.field_name, r.source_id, r.channel)
        written, estimate = table.get(r.unit), near[c] if c in known else far.get(c)
        candidates: list[str] = []
        if estimate:
            value = estimate[0] + (math.log(float(written)) if r.channel == "stated" else 0.0)
            by_distance = sorted(table.values(), key=lambda f: abs(math.log(float(f)) - value))
            reach = max(LEAST_NEAR, NEAR * math.sqrt(estimate[1]))
            candidates = [f for f in by_distance if abs(math.log(float(f)) - value) <= reach] or by_distance[:1]
        if written:
            factor, method = written, "written" if not estimate else "agreed" if written in candidates else "disputed"
        else:
            factor, method = (candidates[0], "linked") if estimate else (None, "unlinked")
        out.append((r.field_name, r.source_id, r.mark, r.unit, Decimal(factor) if factor else None, math.exp(value) if estimate else None, [Decimal(f) for f in candidates], method))
    return spark.createDataFrame(
        out, "field_name string, source_id int, mark string, unit string, factor decimal(18,0), estimate double, candidates array<decimal(18,0)>, method string"
    )


def converted(read: DataFrame, scale: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """trace_id, field_name, entity, the columns to ``keep``, amount: milliseconds and bytes, rounded half up.

    Values of dialects without a scale are left out; :func:`scales` lists them.
    """
    amount = F.round(F.col("x") * F.col("factor").cast("decimal(18,0)"), 0).try_cast("bigint")
    # One row per source, column and unit: at most MOST_DIALECTS.
    return read.join(F.broadcast(scale.select(*DIALECT, "factor")), DIALECT).select(
        "trace_id", "field_name", "entity", *keep, amount.alias("amount")
    ).where(F.col("amount").isNotNull())


def common_units(trace: DataFrame, sources: DataFrame, columns: tuple[str, ...] = (*TIMES, *SIZES), keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`converted` of a trace by the scales found in the same trace; the text is read once."""
    read = written(figures(trace, sources, columns, keep))
    return converted(read, scales(read), keep)
