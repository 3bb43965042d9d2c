"""Bounded micro-batches over files of events, with a watermark and exactly-once results.

The source admits whole files up to a number per trigger, resumes from its checkpoint and
never splits a file; the watermark says how long late events are waited for, and a repeat of
an event inside it counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandframe.session import shared_dir


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4, glob: str = "events.parquet") -> DataFrame:
    """The files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


def tumbling(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type: window_start, event_type, n_events, total_value.

    Events without a time are left out; an event id counts once while the watermark holds it.
    """
    timed = events.where("ts IS NOT NULL").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    once = timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value")).select(
        F.col("w.start").alias("window_start"), "event_type", "n_events", "total_value"
    )


def run(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote under ``path``."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def drop_stale(events: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Per key only rows whose ordinal is beyond all seen before: late frames are dropped by sequence, not by time.

    Works on streams (state per key, one number) and gives ``key``, ``ordinal`` of the rows kept.
    """

    def keep(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))[ordinal].dropna().drop_duplicates().sort_values()
        fresh = rows[rows > last] if last is not None else rows
        if len(fresh):
            state.update((int(fresh.max()),))
        yield pd.DataFrame({key: [name[0]] * len(fresh), ordinal: fresh.to_numpy()})

    kind = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(
        keep, f"{key} {kind[key]}, {ordinal} {kind[ordinal]}", "last bigint", "append", GroupStateTimeout.NoTimeout
    )


def replayed(events: DataFrame, folder: str, chunks: int) -> tuple[int, int]:
    """Writes events with a time as files in order of time, ``chunks`` spans one after the other, then the first span once more
    and one empty-typed event far ahead. Returns the seconds of a span and their number.

    So a stream over the folder sees repeats that come too late, and an end that closes all windows.
    """
    low, high = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    if low is None:
        return 0, 0
    span = (high - low) // chunks + 1
    at = F.floor((F.unix_seconds("ts") - low) / span)
    for k in [*range(chunks), 0]:
        events.where(at == k).write.mode("append").parquet(f"{folder}/in")
    end = events.limit(1).select(*[
        (F.timestamp_seconds(F.lit(high + 3 * span + 7200)) if c == "ts" else F.lit(None).cast(t)).alias(c) for c, t in events.dtypes
    ])
    end.write.mode("append").parquet(f"{folder}/in")
    return span, chunks


def windowed_events(spark: SparkSession, sf_dir: str, chunks: int = 8) -> DataFrame:
    """All events, played in order of time as a stream of files, in hourly windows that the watermark closes.

    The watermark waits for two spans of the replay, so the state holds no more than those and the windows
    in them; the first span comes again at the end and is dropped as late. Windows are written once, when they close.
    """
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    span, _ = replayed(events, folder, chunks)
    if not span:
        return spark.createDataFrame([], "window_start timestamp, event_type string, n_events bigint, total_value double")
    stream = tumbling(event_stream(spark, f"{folder}/in", events.schema, files_per_trigger=8, glob="*.parquet"), late=f"{2 * span} seconds")
    done = run(stream, folder).where("event_type IS NOT NULL")
    return done.withColumn("total_value", F.round("total_value", 4))
