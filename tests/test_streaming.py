"""The event stream: repeats, late rows, resumption and stale frames."""

from datetime import datetime, timedelta

from strandframe.streaming import windows

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
T0 = datetime(2031, 1, 1)


def write(spark, folder, name, rows):
    full = [(i, T0 + timedelta(minutes=m) if m is not None else None, 1, "a", 1.0, "{}") for i, m in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_late_and_repeated_events(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "job"
    write(spark, src, "f1", [(1, 0), (1, 0), (2, 30), (3, None)])
    stream = lambda: windows.tumbling(windows.event_stream(spark, f"{src}/*", SCHEMA, glob="*.parquet"), late="1 hour")
    windows.run(stream(), str(out))
    write(spark, src, "f2", [(4, 600)])
    windows.run(stream(), str(out))
    write(spark, src, "f3", [(5, 10), (6, 1200)])
    got = {(r.window_start, r.n_events) for r in windows.run(stream(), str(out)).collect()}
    assert got == {(T0, 2), (T0 + timedelta(hours=10), 1)}


def test_stale_frames_are_dropped_by_sequence(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "job"
    for n, frames in enumerate(([("a", 1), ("a", 3), ("b", 5)], [("a", 2), ("a", 4), ("b", 5)])):
        spark.createDataFrame(frames, "w string, n bigint").coalesce(1).write.parquet(f"{src}/{n}")
        stream = spark.readStream.schema("w string, n bigint").parquet(f"{src}/*")
        got = windows.run(windows.drop_stale(stream, "w", "n"), str(out))
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("a", 3), ("a", 4), ("b", 5)}
