"""Binary search requests (``UMPROBE1``): fixed rows of ten numbers, then the bytes they point into."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC, HEAD, ROW = b"UMPROBE1", 32, 80
NAMES = ("s0", "s1", "read_len", "start", "length", "prefix", "low", "high", "dir", "tag")
SCHEMA = "path string, req_id bigint, " + ", ".join(f"{n} bigint" for n in NAMES) + ", bases0 binary, bases1 binary"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per request with its read in both encodings (bases0 at s0, bases1 at s1).

    A wrong magic or length, a row that points outside the bytes, or bytes outside the
    alphabet (0 to 4 and 11) raise an error. Files are the unit of work: many files spread
    over the cluster, and a file holds at most four million requests by its format.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                count, size, _ = struct.unpack("<QQQ", content[8:HEAD]) if content[:8] == MAGIC else (0, 0, 0)
                if not 0 < count <= 4_000_000 or len(content) != HEAD + count * ROW + size:
                    raise ValueError(f"not a request file: {path}")
                table = np.frombuffer(content, "<u8", count * 10, HEAD).reshape(count, 10).astype(np.int64)
                arena = content[HEAD + count * ROW :]
                values = np.frombuffer(arena, np.uint8)
                if not ((values <= 4) | (values == 11)).all():
                    raise ValueError(f"bytes outside the alphabet: {path}")
                c = dict(zip(NAMES, table.T))
                reach = np.where(c["dir"] == 1, c["read_len"] - c["start"], c["start"] + 1)
                ok = (c["tag"] == 0) & (c["dir"] <= 1) & (c["read_len"] > 0) & (c["read_len"] <= 4096) & (c["length"] > 0) & (c["prefix"] <= c["length"])
                ok &= (c["start"] < c["read_len"]) & (c["length"] <= reach) & (c["s0"] + c["read_len"] <= size) & (c["s1"] + c["read_len"] <= size)
                if not ok.all():
                    raise ValueError(f"bad request {int(np.argmin(ok))}: {path}")
                for at in range(0, count, 50_000):
                    part = pd.DataFrame({n: v[at : at + 50_000] for n, v in c.items()})
                    part.insert(0, "req_id", np.arange(at, at + len(part)))
                    part.insert(0, "path", path)
                    for n, s in (("bases0", "s0"), ("bases1", "s1")):
                        part[n] = [arena[i : i + k] for i, k in zip(part[s], part["read_len"])]
                    yield part

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, SCHEMA)


def request_bytes(rows: list[tuple[int, ...]], arena: bytes, seed: int = 0) -> bytes:
    """A request file from rows of ten numbers and the bytes."""
    return MAGIC + struct.pack("<QQQ", len(rows), len(arena), seed) + b"".join(struct.pack("<10Q", *r) for r in rows) + arena


TUPLES, CAPTURE, FOOTER = b"UMSTAR01", b"SSIRLE01", 120


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """The results beside a request file: path, req_id, length, low, high, n_places. A wrong magic or length raises an error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                count = struct.unpack("<Q", content[8:16])[0] if content[:8] == TUPLES and len(content) >= 16 else -1
                if len(content) != 16 + 32 * count:
                    raise ValueError(f"not a file of results: {path}")
                table = np.frombuffer(content, "<u8", count * 4, 16).reshape(count, 4).astype(np.int64)
                for at in range(0, count, 100_000):
                    part = pd.DataFrame(table[at : at + 100_000], columns=["length", "low", "high", "n_places"])
                    part.insert(0, "req_id", np.arange(at, at + len(part)))
                    part.insert(0, "path", path)
                    yield part

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, req_id bigint, length bigint, low bigint, high bigint, n_places bigint")


_INNER = ("request", "read", "f2", "f3", "f4", "f5", "f6", "start", "length", "low", "high", "prefix", "out_length", "out_low", "out_high", "out_places")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Search requests as the aligner recorded them, with its own results: path, read_no, seq_no, the sixteen numbers, dir, bases0, bases1.

    The format: magic, length of the header at byte 12, framed records (size, kind, flags, sequence number; kind 1 a request, kind 2
    the end of a read), and a footer whose last 32 bytes are the SHA-256 of all before it. A wrong hash, a bad frame, a request outside
    its read, and requests of a read that does not end before the footer raise an error. Files are the unit of work.
    """
    import hashlib

    schema = "path string, read_no bigint, seq_no bigint, " + ", ".join(f"{n} bigint" for n in _INNER) + ", dir int, bases0 binary, bases1 binary"

    def frames(path: str, data: bytes) -> Iterator[tuple]:
        end = len(data) - FOOTER
        if data[:8] != CAPTURE or end < 160 or hashlib.sha256(data[:end]).digest() != data[-32:]:
            raise ValueError(f"not a complete capture: {path}")
        at, read_no, open_ = struct.unpack_from("<I", data, 12)[0], 0, False
        while at < end:
            size, kind, flags, seq_no = struct.unpack_from("<IHHQ", data, at) if at + 16 <= end else (0, 0, 0, 0)
            if flags or size < 16 or at + size > end or kind not in (1, 2) or (kind == 1 and size < 240):
                raise ValueError(f"bad frame at {at}: {path}")
            if kind == 1:
                values, n0, n1 = struct.unpack_from("<16Q", data, at + 16), *struct.unpack_from("<II", data, at + 148)
                start, length, low, high, prefix = values[7:12]
                if n0 != n1 or 240 + n0 + n1 != size or not (0 < length and prefix <= length and low <= high and start < n0):
                    raise ValueError(f"bad request at {at}: {path}")
                bases = at + 240
                yield (path, read_no, seq_no, *values, data[at + 144], data[bases : bases + n0], data[bases + n0 : bases + n0 + n1])
                open_ = True
            else:
                read_no, open_ = read_no + 1, False
            at += size
        if open_:
            raise ValueError(f"a read does not end before the footer: {path}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "read_no", "seq_no", *_INNER, "dir", "bases0", "bases1"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                part = []
                for row in frames(path, content):
                    part.append(row)
                    if len(part) == 20_000:
                        yield pd.DataFrame(part, columns=columns)
                        part = []
                yield pd.DataFrame(part, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, schema)
