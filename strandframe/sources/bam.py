"""BAM files as a Spark data source (``spark.read.format("bam")``), and as a sink of parts with an index.

A file with a ``.bai`` index beside it is read in parallel from the virtual offsets of the index, which
always point at records. One without is cut at even distances; each task looks for the first record
after its cut, and a task whose records do not meet the next one's first is an error, so nothing is lost
or read twice. A folder written by ``write_bam`` is read part by part. ``rec_idx`` is the record's virtual
offset, with the sizes of the files before its own added: it grows in file order and does not depend on
the partitions; ``rec_end`` is where the record ends. Paths must be reachable by all executors.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandframe.functions import cigar as cigars
from strandframe.functions import flags

SCHEMA = (
    "rec_idx bigint, qname string, flag int, tid int, pos int, mapq int, cigar string, mate_tid int, mate_pos int, tlen int, "
    "body_len int, seq string, qual array<smallint>, nh int, hi int, rec_end bigint"
)
OPS, BASES = "MIDNSHP=XB", "=ACMGRSVTWYHKDBN"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
#: Compressed bytes of a partition at least, where a file is split.
SPLIT = 32 << 20
#: Records in a row that must fit before the first of them is taken for one; fewer only where the file ends.
FITTING = 12
#: Raw bytes of a written block at most.
BLOCK = 65_280


class Blocks:
    """Bytes of a BGZF file from a virtual offset on."""

    def __init__(self, path: str, offset: int = 0):
        self.file = open(path, "rb")
        self.at, skip = offset >> 16, offset & 0xFFFF
        self.data, self.place = b"", 0
        self.file.seek(self.at)
        self.next = self.at
        if self._load():
            self.place = skip

    def _load(self) -> bool:
        head = self.file.read(18)
        if not head:
            return False
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        size = struct.unpack("<H", head[16:18])[0] + 1
        body = self.file.read(size - 18)
        if len(body) < size - 18:
            raise ValueError("truncated BGZF block")
        self.at, self.next = self.next, self.next + size
        self.data, self.place = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        while self.place == len(self.data):
            if not self._load():
                return self.next << 16
        return self.at << 16 | self.place

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.place == len(self.data) and not self._load():
                break
            piece = self.data[self.place : self.place + n - len(out)]
            self.place += len(piece)
            out += piece
        return out


def read_header(blocks: Blocks) -> list[tuple[str, int]]:
    """References (name, length) of a BAM header; the list's order gives the tid."""
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return refs


def tags(data: bytes) -> dict[str, int]:
    """The integer tags of a record, signed as written."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(data[at])] * struct.unpack("<i", data[at + 1 : at + 5])[0]
        else:
            if kind in _INTS:
                out[name] = struct.unpack(_INTS[kind], data[at : at + _SIZES[kind]])[0]
            at += _SIZES[kind]
    return out


def decode(body: bytes, rec_idx: int) -> tuple:
    """One record's columns; a body too short for what it announces is an error."""
    if len(body) < 32:
        raise ValueError("record shorter than its fixed fields")
    tid, pos, name_len, mapq, _, n_ops, flag, l_seq, mate_tid, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", body[:32])
    ops_at, seq_at = 32 + name_len, 32 + name_len + 4 * n_ops
    qual_at = seq_at + (l_seq + 1) // 2
    if l_seq < 0 or not name_len or qual_at + l_seq > len(body) or body[31 + name_len]:
        raise ValueError("bad record layout")
    packed = struct.unpack(f"<{n_ops}I", body[ops_at:seq_at])
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in packed) or "*"
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in body[seq_at:qual_at])[:l_seq]
    found = tags(body[qual_at + l_seq :])
    return (rec_idx, body[32 : 31 + name_len].decode(), flag, tid, pos, mapq, cigar, mate_tid, mate_pos, tlen, len(body), seq,
            list(body[qual_at : qual_at + l_seq]), found.get("NH"), found.get("HI"))


def _fits(body: bytes, size: int, refs: list[tuple[str, int]]) -> bool:
    """Whether the first bytes of what may be a record of this size agree with each other and with the references."""
    tid, pos, name_len, _, _, n_ops, _, l_seq, mate_tid, mate_pos, _ = struct.unpack("<iiBBHHHiiii", body[:32])
    for at, place in ((tid, pos), (mate_tid, mate_pos)):
        if not -1 <= at < len(refs) or not -1 <= place <= (refs[at][1] if at >= 0 else 1 << 31):
            return False
    return name_len > 0 and l_seq >= 0 and 32 + name_len + 4 * n_ops + (l_seq + 1) // 2 + l_seq <= size and body[31 + name_len : 32 + name_len] == b"\0"


def _chain(path: str, offset: int, refs: list[tuple[str, int]]) -> bool:
    """Whether records follow each other from a virtual offset on."""
    blocks = Blocks(path, offset)
    for _ in range(FITTING):
        head = blocks.read(4)
        if not head:
            return True
        size = struct.unpack("<i", head)[0] if len(head) == 4 else 0
        if not 33 <= size < 1 << 28:
            return False
        body = blocks.read(min(size, 288))
        if len(body) < min(size, 288) or not _fits(body, size, refs):
            return False
        if len(blocks.read(size - len(body))) < size - len(body):
            return False
    return True


def first_record(path: str, start: int, refs: list[tuple[str, int]]) -> int | None:
    """The virtual offset of the first record that begins in a block at or after a place of the file; None if there is none."""
    length = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(start)
        window = f.read(1 << 17)
    at = -1
    while (at := window.find(b"\x1f\x8b\x08\x04", at + 1)) >= 0:
        try:
            blocks = Blocks(path, start + at << 16)
            # A block is followed by a block or by the end of the file.
            with open(path, "rb") as f:
                f.seek(blocks.next)
                if blocks.next != length and f.read(4) != b"\x1f\x8b\x08\x04":
                    continue
        except (ValueError, zlib.error, struct.error):
            continue
        while True:
            here, data = blocks.at, blocks.data
            for skip in range(len(data)):
                # Cheap test first: the size's upper byte, and a reference that exists.
                if skip + 8 <= len(data) and (data[skip + 3] > 15 or not -1 <= struct.unpack_from("<i", data, skip + 4)[0] < len(refs)):
                    continue
                if _chain(path, here << 16 | skip, refs):
                    return here << 16 | skip
            if not blocks._load():
                return None
    return None


def encode(row, name_len_limit: int = 254) -> bytes:
    """The body of a record from columns; missing ones take the format's defaults."""
    get = lambda n, d: d if (v := getattr(row, n, None)) is None else v
    name = get("qname", "*").encode()[:name_len_limit] + b"\0"
    ops = [(int(n) << 4) | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=XB])", get("cigar", "*"))]
    seq = get("seq", "")
    codes = [BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes(get("qual", [255] * len(seq)))
    extra = b"".join(n.encode() + b"i" + struct.pack("<i", v) for n in ("NH", "HI") if (v := getattr(row, n.lower(), None)) is not None)
    pos = get("pos", -1)
    fixed = struct.pack("<iiBBHHHiiii", get("tid", -1), pos, len(name), get("mapq", 255), 4680, len(ops), get("flag", 4), len(seq), get("mate_tid", -1), get("mate_pos", -1), get("tlen", 0))
    return fixed + name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + extra


def block(raw: bytes) -> bytes:
    """One BGZF block."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def header_bytes(refs: list[tuple[str, int]]) -> bytes:
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in refs)
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


def index_offsets(path: str) -> list[int]:
    """Virtual offsets of the linear index of a ``.bai`` file, ascending."""
    with open(path, "rb") as f:
        if f.read(4) != b"BAI\x01":
            raise ValueError("not a BAI index")
        offsets: set[int] = set()
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            for _ in range(struct.unpack("<i", f.read(4))[0]):
                n = struct.unpack("<Ii", f.read(8))[1]
                f.read(16 * n)
            n = struct.unpack("<i", f.read(4))[0]
            offsets.update(struct.unpack(f"<{n}Q", f.read(8 * n)))
    return sorted(offsets - {0, (1 << 64) - 1})


class _Part(InputPartition):
    """Records of a file from ``start`` to ``end``: virtual offsets, or where ``cut`` says so bytes to look for records from."""

    def __init__(self, path: str, base: int, start: int | None, end: int | None, cut: bool, header: bool):
        self.path, self.base, self.start, self.end, self.cut, self.header = path, base, start, end, cut, header


class BamReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"]
        self.parts = os.path.exists(f"{path}/header.bgzf")
        if self.parts:
            self.paths = [f"{path}/header.bgzf", *sorted(glob.glob(f"{path}/part-*.bgzf"))]
        else:
            self.paths = sorted(glob.glob(f"{path}/*.bam")) if os.path.isdir(path) else sorted(glob.glob(path))

        if not self.paths:
            raise FileNotFoundError(f"no BAM file at {path}")

    def partitions(self):
        parts, base = [], 0
        for path in self.paths:
            size = os.path.getsize(path)
            if self.parts:
                parts += [_Part(path, base, None, None, False, False)] if base else []
            elif os.path.exists(path + ".bai"):
                cuts: list[int] = []
                for offset in index_offsets(path + ".bai"):
                    if (offset >> 16) - ((cuts[-1] >> 16) if cuts else 0) >= SPLIT:
                        cuts.append(offset)
                edges = [None, *cuts, None]
                parts += [_Part(path, base, a, b, False, True) for a, b in zip(edges, edges[1:])]
            else:
                edges = [None, *range(SPLIT, size - SPLIT // 2, SPLIT), None]
                parts += [_Part(path, base, a, b, True, True) for a, b in zip(edges, edges[1:])]
            base += size
        if base >= 1 << 47:
            raise ValueError("more than 2^47 bytes of files: read them in several loads")
        return parts

    def read(self, partition) -> Iterator[tuple]:
        path, start, end = partition.path, partition.start, partition.end
        if partition.cut and (start is not None or end is not None):
            refs = read_header(Blocks(path))
            if start is not None and (start := first_record(path, start, refs)) is None:
                return
            end = None if end is None else first_record(path, end, refs)
        blocks = Blocks(path, start or 0)
        if start is None and partition.header:
            read_header(blocks)
        shift, at = partition.base << 16, blocks.tell()
        while end is None or at < end:
            size = blocks.read(4)
            if not size:
                break
            if len(size) < 4:
                raise ValueError("truncated block size")
            body = blocks.read(n := struct.unpack("<i", size)[0])
            if len(body) < n:
                raise ValueError("truncated record body")
            here, at = at, blocks.tell()
            yield (*decode(body, shift + here), shift + at)
        if partition.cut and end is not None and at > end and start != end:
            raise ValueError("records do not meet at a cut of the file")


class _Done(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class BamWriter(DataSourceWriter):
    """Each task writes its rows as blocks of whole records; header and end marker come at the commit.

    The parts in name order between ``header.bgzf`` and ``eof.bgzf`` are one BAM file; ``read_bam`` takes the folder too.
    """

    def __init__(self, options):
        self.folder = options["path"]
        self.refs = [(n, int(length)) for n, length in (x.split(":") for x in options["refs"].split(","))]
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        final = f"{self.folder}/part-{context.partitionId():06d}.bgzf"
        draft = f"{final}.{context.taskAttemptId()}"
        with open(draft, "wb") as f:
            raw = b""
            for row in rows:
                body = encode(row)
                record = struct.pack("<i", len(body)) + body
                if len(record) > BLOCK:
                    raise ValueError("record larger than a block")
                if len(raw) + len(record) > BLOCK:
                    f.write(block(raw))
                    raw = b""
                raw += record
            if raw:
                f.write(block(raw))
        os.replace(draft, final)
        return _Done(final)

    def commit(self, messages):
        with open(f"{self.folder}/header.bgzf", "wb") as f:
            f.write(block(header_bytes(self.refs)))
        with open(f"{self.folder}/eof.bgzf", "wb") as f:
            f.write(block(b""))

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """The records of a BAM file, a glob, a folder of them or a folder of parts. ``tid`` and ``pos`` are -1 where there is no place."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("path", path).load()


def _references(path: str) -> list[tuple[str, int]]:
    return read_header(Blocks(f"{path}/header.bgzf" if os.path.isdir(path) else path))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """tid, ref_name and ref_length from the header of one BAM file or folder of parts."""
    rows = [(i, n, length) for i, (n, length) in enumerate(_references(path))]
    return spark.createDataFrame(rows, "tid int, ref_name string, ref_length bigint")


def write_bam(records: DataFrame, refs: list[tuple[str, int]], folder: str) -> None:
    """Records in coordinate order (range-partitioned, then sorted) as the parts of one BAM file.

    Records without a place come last. ``folder`` must be reachable by all executors.
    """
    records.sparkSession.dataSource.register(BamSource)
    place = F.when(F.col("tid") >= 0, F.col("tid")).otherwise(F.lit(2**31 - 1))
    ordered = records.withColumn("__place", place).repartitionByRange("__place", "pos", "rec_idx").sortWithinPartitions("__place", "pos", "rec_idx").drop("__place")
    ordered.write.format("bam").mode("append").option("path", folder).option("refs", ",".join(f"{n}:{length}" for n, length in refs)).save()


#: Fixed values of the index format: the bin that holds the counts, and the first coordinate no bin covers.
COUNTS_BIN, LIMIT = 37_450, 1 << 29


def index_rows(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an index says, from rec_idx, rec_end, tid, pos, flag and cigar: chunks per bin, first records per 16 kb, counts per reference.

    Chunks are first made per bin and block of the file, before the shuffle, then those that share a block are
    joined. A record without a length on the reference counts as one base. A window of 16 kb in which
    nothing lies takes the value of the next one. Records without a place are left out here.
    """
    length = F.greatest(cigars.reference_length(cigars.ops(F.col("cigar"))), F.lit(1))
    placed = records.where("tid >= 0 and pos >= 0").select("tid", "pos", "flag", "rec_idx", "rec_end", (F.col("pos") + F.when(flags.has(4), 1).otherwise(length)).alias("stop"))
    checked = placed.withColumn("stop", F.when(F.col("stop") <= LIMIT, F.col("stop")).otherwise(F.raise_error(F.lit("a record beyond the last place an index covers")).cast("bigint")))
    binned = checked.select(
        "tid", "rec_idx", "rec_end", flags.reg2bin(F.col("pos"), F.col("stop")).alias("bin"), F.shiftright("pos", 14).cast("bigint").alias("low"), F.shiftright(F.col("stop") - 1, 14).cast("bigint").alias("high"),
        F.shiftright("rec_idx", 16).alias("block"), flags.has(4).cast("bigint").alias("unmapped"),
    )
    pieces = binned.groupBy("tid", "bin", "block").agg(F.min("rec_idx").alias("begin"), F.max("rec_end").alias("end"))
    order = Window.partitionBy("tid", "bin").orderBy("begin")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.shiftright("begin", 16) > F.shiftright(reach, 16)).cast("int"), F.lit(1))
    runs = pieces.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    chunks = runs.groupBy("tid", "bin", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("tid", "bin", "begin", "end")
    firsts = binned.groupBy("tid", "low", "high").agg(F.min("rec_idx").alias("first")).select("tid", F.explode(F.sequence("low", "high")).alias("part"), "first")
    seen = firsts.groupBy("tid", "part").agg(F.min("first").alias("first"))
    every = seen.groupBy("tid").agg(F.max("part").alias("top")).select("tid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("part"))
    later = Window.partitionBy("tid").orderBy("part").rowsBetween(0, Window.unboundedFollowing)
    linear = every.join(seen, ["tid", "part"], "left").select("tid", "part", F.first("first", ignorenulls=True).over(later).alias("first"))
    counts = binned.groupBy("tid").agg(F.min("rec_idx").alias("begin"), F.max("rec_end").alias("end"), F.sum(1 - F.col("unmapped")).alias("mapped"), F.sum("unmapped").alias("unmapped"))
    return chunks, linear, counts


def write_index(spark: SparkSession, path: str) -> str:
    """The ``.bai`` of one coordinate-sorted BAM file, beside it, or of a folder of parts (``index.bai``, for the parts joined).

    The index is worked out by Spark; the driver writes it reference by reference and never holds more than one
    reference's bins (at most 37,449) and 16 kb windows (at most 32,768), with a chunk or two a block of the file.
    """
    records = read_bam(spark, path).select("rec_idx", "rec_end", "tid", "pos", "flag", "cigar")
    chunks, linear, counts = index_rows(records)
    bins = chunks.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("bin", "begin", "end"))).alias("chunks"))
    windows = linear.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("part", "first"))).alias("windows"))
    rows = bins.join(windows, "tid").join(counts, "tid").orderBy("tid")
    n_refs, homeless = len(_references(path)), records.where("tid < 0 or pos < 0").count()
    out = f"{path}/index.bai" if os.path.isdir(path) else f"{path}.bai"
    with open(f"{out}.draft", "wb") as f:
        f.write(b"BAI\x01" + struct.pack("<i", n_refs))
        done = 0
        for row in rows.toLocalIterator():
            f.write(struct.pack("<ii", 0, 0) * (row.tid - done))
            by_bin: dict[int, list[tuple[int, int]]] = {}
            for c in row.chunks:
                by_bin.setdefault(c.bin, []).append((c.begin, c.end))
            f.write(struct.pack("<i", len(by_bin) + 1))
            for number, found in by_bin.items():
                f.write(struct.pack("<Ii", number, len(found)) + b"".join(struct.pack("<QQ", *c) for c in found))
            f.write(struct.pack("<IiQQQQ", COUNTS_BIN, 2, row.begin, row.end, row.mapped, row.unmapped))
            f.write(struct.pack("<i", len(row.windows)) + b"".join(struct.pack("<Q", w.first) for w in row.windows))
            done = row.tid + 1
        f.write(struct.pack("<ii", 0, 0) * (n_refs - done) + struct.pack("<Q", homeless))
    os.replace(f"{out}.draft", out)
    return out
