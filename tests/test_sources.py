"""Readers and writers: round trips and malformed input."""

import glob
import random
import re
import struct

import pytest
from pyspark.sql import Row

from strandframe.operators import reports
from strandframe.sources import bam, render, requests, text


def test_gtf_and_bed(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(
        '#c\nchr1\tx\texon\t11\t20\t.\t+\t.\tgene_id "G1"; t "a";\nchr1\tx\tgene\t1\t20\t.\t+\t.\tgene_id "G1";\nshort\tline\n'
        'chr2\tx\texon\t5\t9\t.\t-\t.\tt "b"; gene_id "G2";\n')
    got = [tuple(r) for r in text.read_gtf(spark, str(tmp_path / "a.gtf")).orderBy("ord_no").collect()]
    assert got == [(1, "chr1", "exon", 10, 20, "+", "G1"), (4, "chr2", "exon", 4, 9, "-", "G2")]
    (tmp_path / "b.gtf").write_text("chr1\tx\texon\t11\t20\t.\t+\t.\tno id\n")
    with pytest.raises(Exception, match="without gene_id"):
        text.read_gtf(spark, str(tmp_path / "b.gtf")).collect()
    (tmp_path / "a.bed").write_text("track x\n#c\nchr1 100 200 tx 0 + 110 190 0 2 20,30, 0,70,\nchr1 1 2 few\n")
    r = text.read_bed12(spark, str(tmp_path / "a.bed")).first()
    assert (r.chrom, r.thick_start, [tuple(e) for e in r.exons]) == ("chr1", 110, [(100, 120), (170, 200)])


def test_fastq_and_grid(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a 1\nACGTACGTACGTACGTACGTACGT\n+\n" + "I" * 24 + "\n@b\nNNN\n+\nIII\n")
    reads = text.read_fastq(spark, str(tmp_path / "r.fq"))
    assert [(r.read_no, r.name, len(r.seq)) for r in reads.orderBy("read_no").collect()] == [(0, "a", 24), (1, "b", 3)]
    grid = {(r.read_no, r.dir, r.start, r.length) for r in text.request_grid(reads).collect()}
    assert grid == {(0, 1, 0, 24), (0, 0, 0, 1), (0, 1, 20, 4), (0, 0, 20, 21)}
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="bad read record"):
        text.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_profile_and_timings(spark, tmp_path):
    (tmp_path / "p").write_text("12\n\tff memcpy ([kernel.kallsyms])\n\t0a run (/bin/tool)\n\n13\n\t0a run (/bin/tool)\n")
    frames = text.read_profile(spark, str(tmp_path / "p"))
    assert [(r.sample_no, r.depth, r.symbol, r.module) for r in frames.orderBy("sample_no", "depth").collect()] == [
        (1, 0, "memcpy", "[kernel.kallsyms]"), (1, 1, "run", "tool"), (2, 0, "run", "tool")]
    assert {(r.sample_no, r.leaf, r.caller) for r in text.profile_callers(frames).collect()} == {(1, "memcpy", "run"), (2, "run", None)}
    (tmp_path / "t.tsv").write_text("repeat\tarm\twall_s\tuser_s\tsys_s\tmax_rss_kib\texit\n1\tgpu\t1.5\t2\t3\t4\t0\n2\tgpu\t1\t1\t1\t1\t1\n")
    rows = text.read_timings(spark, str(tmp_path / "t.tsv"))
    assert rows.where("repeat = 1").first().wall_s == 1.5
    with pytest.raises(Exception, match="cleanly"):
        rows.collect()


def test_profile_over_many_splits(spark, tmp_path):
    want, lines = [], []
    for sample in range(300):
        lines.append(str(sample % 7))
        for depth in range(sample % 4 + 1):
            lines.append(f"\tff f{depth} (/bin/m)")
            want.append((sample + 1, sample % 7, depth, f"f{depth}"))
        lines.append("")
    (tmp_path / "p").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        frames = text.read_profile(spark, str(tmp_path / "p"))
        assert text.numbered_lines(spark, str(tmp_path / "p")).select("block").distinct().count() > 5
        assert sorted((r.sample_no, r.thread, r.depth, r.symbol) for r in frames.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def records():
    return [
        Row(rec_idx=0, qname="a", flag=99, tid=1, pos=50, mapq=60, cigar="5M", mate_tid=1, mate_pos=80, tlen=35, seq="ACGTN", qual=[1, 2, 3, 4, 255], nh=1, hi=None),
        Row(rec_idx=1, qname="b", flag=4, tid=-1, pos=-1, mapq=0, cigar="*", mate_tid=-1, mate_pos=-1, tlen=0, seq="", qual=[], nh=None, hi=None),
        Row(rec_idx=2, qname="c", flag=0, tid=0, pos=7, mapq=255, cigar="2S3M1D4=", mate_tid=-1, mate_pos=-1, tlen=0, seq="ACGTACGTA", qual=[9] * 9, nh=300, hi=2),
    ]


SCHEMA = ("rec_idx bigint, qname string, flag int, tid int, pos int, mapq int, cigar string, mate_tid int, mate_pos int, tlen int, "
          "seq string, qual array<smallint>, nh int, hi int")


def test_bam_round_trip(spark, tmp_path):
    folder = tmp_path / "out"
    bam.write_bam(spark.createDataFrame(records(), SCHEMA), [("chr1", 1000), ("chr2", 500)], str(folder))
    parts = sorted(folder.glob("part-*.bgzf"))
    whole = tmp_path / "x.bam"
    whole.write_bytes((folder / "header.bgzf").read_bytes() + b"".join(p.read_bytes() for p in parts) + (folder / "eof.bgzf").read_bytes())
    got = bam.read_bam(spark, str(whole)).orderBy("rec_idx").collect()
    assert [(r.qname, r.tid, r.pos, r.cigar, r.seq, r.qual, r.nh, r.hi) for r in got] == [
        (x.qname, x.tid, x.pos, x.cigar, x.seq, x.qual, x.nh, x.hi) for x in (records()[2], records()[0], records()[1])]
    assert [tuple(r) for r in bam.read_references(spark, str(whole)).collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]


def test_bam_splits_at_index_offsets(spark, tmp_path, monkeypatch):
    rows = [r for i in range(40) for r in [records()[0]]]
    raw = [struct.pack("<i", len(b := bam.encode(r))) + b for r in rows]
    head = bam.block(bam.header_bytes([("chr1", 10)]))
    data, starts = head, []
    for i in range(0, 40, 10):
        starts.append(len(data) << 16)
        data += bam.block(b"".join(raw[i : i + 10]))
    path = tmp_path / "s.bam"
    path.write_bytes(data + bam.block(b""))
    (tmp_path / "s.bam.bai").write_bytes(b"BAI\x01" + struct.pack("<iii", 1, 0, 3) + struct.pack("<3Q", *starts[1:]))
    monkeypatch.setattr(bam, "SPLIT", 1)
    reader = bam.BamReader({"path": str(path)})
    parts = reader.partitions()
    found = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 4 and len(found) == 40 and len({r[0] for r in found}) == 40 and [r[0] for r in found] == sorted(r[0] for r in found)
    path.write_bytes(data[:-20])
    with pytest.raises(ValueError, match="truncated"):
        list(reader.read(parts[-1]))


def many_records(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        placed, length = rng.random() < 0.95, rng.choice([0, 1, 36, 100, 250])
        tid = rng.choice([0, 0, 0, 2]) if placed else -1
        gap = rng.choice([0, 0, 0, 90_000])
        text = (f"{length // 2}M{gap}N{length - length // 2}M" if gap and length > 1 else f"{length}M") if length else "*"
        rows.append(Row(rec_idx=i, qname=f"q{i}", flag=rng.choice([0, 16]) if placed and length else 4, tid=tid, pos=rng.choice([77, rng.randrange(900_000)]) if placed else -1, mapq=60,
                        cigar=text, mate_tid=-1, mate_pos=-1, tlen=0, seq="".join(rng.choices("ACGT", k=length)), qual=[rng.randrange(41) for _ in range(length)], nh=1, hi=None))
    return rows


def test_bam_without_an_index_is_cut_into_tasks(tmp_path, monkeypatch):
    rows = many_records(3000)
    rows[1500] = Row(**{**rows[1500].asDict(), "seq": "A" * 90_000, "qual": [0] * 90_000, "cigar": "90000M"})
    raw = b"".join(struct.pack("<i", len(b := bam.encode(r))) + b for r in rows)
    size, path = 3001, tmp_path / "s.bam"
    path.write_bytes(bam.block(bam.header_bytes([("a", 1 << 20), ("b", 5), ("c", 1 << 20)])) + b"".join(bam.block(raw[i : i + size]) for i in range(0, len(raw), size)) + bam.block(b""))
    whole = list(bam.BamReader({"path": str(path)}).read(bam.BamReader({"path": str(path)}).partitions()[0]))
    assert [r[1] for r in whole] == [r.qname for r in rows]
    for split in (16_000, 40_000):
        monkeypatch.setattr(bam, "SPLIT", split)
        reader = bam.BamReader({"path": str(path)})
        parts = reader.partitions()
        assert len(parts) > 5 and [r for p in parts for r in reader.read(p)] == whole
    monkeypatch.setattr(bam, "first_record", lambda path, start, refs, real=bam.first_record: real(path, start, refs) + (3 if start == 80_000 else 0))
    with pytest.raises(ValueError, match="do not meet"):
        list(reader.read(parts[1]))


def test_bam_parts_and_their_index(spark, tmp_path):
    rows, folder = many_records(3000), str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bam.write_bam(spark.createDataFrame(rows, SCHEMA).repartition(7), [("a", 1 << 20), ("b", 5), ("c", 1 << 20)], folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {r.rec_idx: r for r in bam.read_bam(spark, folder).collect()}
    assert len(found) == 3000 and bam.read_bam(spark, folder).rdd.getNumPartitions() > 1
    data = open(bam.write_index(spark, folder), "rb").read()
    whole = tmp_path / "x.bam"
    whole.write_bytes(b"".join(open(f, "rb").read() for f in [f"{folder}/header.bgzf", *sorted(glob.glob(f"{folder}/part-*.bgzf")), f"{folder}/eof.bgzf"]))
    assert open(bam.write_index(spark, str(whole)), "rb").read() == data
    assert {r.rec_idx: r.qname for r in bam.read_bam(spark, str(whole)).collect()} == {k: r.qname for k, r in found.items()}

    take = lambda f, at: (struct.unpack_from(f, data, at), at + struct.calcsize(f))
    (n_refs,), at = take("<i", 4)
    index = []
    for _ in range(n_refs):
        bins = {}
        (n_bins,), at = take("<i", at)
        for _ in range(n_bins):
            (number, n), at = take("<Ii", at)
            flat, at = take(f"<{2 * n}Q", at)
            bins[number] = list(zip(flat[::2], flat[1::2]))
        (n,), at = take("<i", at)
        windows, at = take(f"<{n}Q", at)
        index.append((bins, windows))
    (homeless,), at = take("<Q", at)
    assert at == len(data) and n_refs == 3 and index[1] == ({}, ()) and homeless == sum(r.tid < 0 for r in rows)

    def stop(r):
        return r.pos + max(1, 0 if r.flag & 4 else sum(int(n) for n, o in re.findall(r"(\d+)([MDN=X])", r.cigar)))

    for tid in (0, 2):
        bins, windows = index[tid]
        here = [r for r in found.values() if r.tid == tid]
        assert bins[37_450][1] == (sum(not r.flag & 4 for r in here), sum(bool(r.flag & 4) for r in here))
        for a, b in ((0, 100), (70, 78), (16_000, 17_000), (500_000, 500_001), (0, 1 << 20), (899_000, 999_000)):
            # The bins a region touches, by the format's five levels.
            touched = {0} | {first + k for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)) for k in range(a >> shift, (b - 1 >> shift) + 1)}
            least = windows[a >> 14] if a >> 14 < len(windows) else 1 << 63
            spans = [(max(x, least), y) for number in touched for x, y in bins.get(number, [])]
            reached = {r.rec_idx for r in here if any(x <= r.rec_idx < y for x, y in spans)}
            assert reached >= {r.rec_idx for r in here if r.pos < b and stop(r) > a}
            if b - a < 2000:
                assert len(reached) < len(here)


def test_bam_of_nothing_and_missing_files(spark, tmp_path):
    folder = str(tmp_path / "none")
    bam.write_bam(spark.createDataFrame([], SCHEMA), [("a", 10)], folder)
    assert bam.read_bam(spark, folder).count() == 0 and bam.read_references(spark, folder).count() == 1
    assert open(bam.write_index(spark, folder), "rb").read() == b"BAI\x01" + struct.pack("<iiiQ", 1, 0, 0, 0)
    with pytest.raises(Exception, match="no BAM file"):
        bam.read_bam(spark, str(tmp_path / "gone.bam")).count()


def test_short_and_bad_records():
    with pytest.raises(ValueError, match="shorter"):
        bam.decode(b"x" * 8, 0)
    with pytest.raises(ValueError, match="layout"):
        bam.decode(bam.encode(records()[0])[:40], 0)
    assert bam.tags(b"NHc\xffXXZab\0HIS\x01\x01BBBc\x02\0\0\0ab") == {"NH": -1, "HI": 257}


def test_requests(spark, tmp_path):
    row = (0, 4, 4, 1, 3, 0, 0, 9, 1, 0)
    (tmp_path / "q.bin").write_bytes(requests.request_bytes([row], bytes([0, 1, 2, 3, 3, 2, 1, 0])))
    r = requests.read_requests(spark, str(tmp_path / "q.bin")).first()
    assert (r.start, r.length, bytes(r.bases0), bytes(r.bases1)) == (1, 3, b"\0\1\2\3", b"\3\2\1\0")
    for bad in ((0, 4, 4, 1, 4, 0, 0, 9, 1, 0), (0, 5, 4, 1, 3, 0, 0, 9, 1, 0), (0, 4, 4, 1, 3, 0, 0, 9, 1, 1)):
        (tmp_path / "bad.bin").write_bytes(requests.request_bytes([bad], bytes(8)))
        with pytest.raises(Exception, match="bad request"):
            requests.read_requests(spark, str(tmp_path / "bad.bin")).collect()


def test_texts(spark, tmp_path):
    aln = spark.createDataFrame(records(), SCHEMA)
    from pyspark.sql import functions as F

    aln = aln.withColumn("is_dup", F.lit(False))
    lines = render.flagstat_text(reports.flagstat(aln)).splitlines()
    assert len(lines) == 16 and lines[6] == "2 + 0 mapped (66.67% : N/A)" and lines[13].endswith("singletons (0.00% : N/A)")
    assert "(N/A : N/A)" in render.flagstat_text(reports.flagstat(aln.limit(0)))
    assert f"{'Total records:':<40}3\n" in render.bam_stat_text(reports.bam_stat(aln))
    none = spark.createDataFrame([], "code string, n bigint")
    assert "determine: NaN" in render.infer_text(none)
    refs = spark.createDataFrame([(0, "chr1", 1000), (1, "chr2", 500)], "tid int, ref_name string, ref_length bigint")
    render.write_idxstats(reports.idxstats(aln, refs), str(tmp_path / "idx"))
    assert [r.value for r in spark.read.text(str(tmp_path / "idx")).collect()] == ["chr1\t1000\t1\t0", "chr2\t500\t1\t0", "*\t0\t0\t1"]
    render.write_bedgraph(reports.coverage(aln, refs), refs, str(tmp_path / "cov"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "cov")).collect()) == ["chr1\t11\t15\t1", "chr1\t7\t10\t1", "chr2\t50\t55\t1"]


def test_captures_and_their_results(spark, tmp_path):
    import hashlib
    import struct

    from strandframe.sources import requests as Q

    def inner(request, read, start, length, bases):
        v = [request, read, 0, 0, 0, 0, 0, start, length, 3, 9, 1, 7, 4, 5, 2]
        body = struct.pack("<16Q", *v) + bytes([1, 0, 0, 0]) + struct.pack("<II", len(bases), len(bases)) + bytes(84) + bases + bases[::-1]
        return struct.pack("<IHHQ", 16 + len(body), 1, 0, request) + body

    def capture(frames):
        data = b"SSIRLE01" + struct.pack("<II", 1, 160) + bytes(144) + frames
        return data + bytes(Q.FOOTER - 32) + hashlib.sha256(data).digest()

    end = struct.pack("<IHHQ", 16, 2, 0, 0)
    good = capture(inner(1, 0, 0, 4, b"\x00\x01\x02\x03") + inner(2, 0, 2, 2, b"\x00\x01\x02\x03") + end + inner(3, 1, 0, 1, b"\x03") + end)
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.bin").write_bytes(good)
    rows = Q.read_captures(spark, str(tmp_path / "good")).orderBy("request").collect()
    assert [(r.read_no, r.start, r.length, r.out_places, r.dir, bytes(r.bases1)) for r in rows] == [
        (0, 0, 4, 2, 1, b"\x03\x02\x01\x00"), (0, 2, 2, 2, 1, b"\x03\x02\x01\x00"), (1, 0, 1, 2, 1, b"\x03")]
    for n, bad in enumerate((good[:-1] + b"x", capture(inner(1, 0, 0, 4, b"\x00\x01\x02\x03")), capture(inner(1, 0, 9, 4, b"\x00\x01") + end), good[:50])):
        (tmp_path / f"bad{n}").mkdir()
        (tmp_path / f"bad{n}" / "a.bin").write_bytes(bad)
        with pytest.raises(Exception, match="capture|footer|request|frame"):
            Q.read_captures(spark, str(tmp_path / f"bad{n}")).collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.star-tuples.bin").write_bytes(b"UMSTAR01" + struct.pack("<9Q", 2, 1, 2, 3, 4, 5, 6, 7, 8))
    assert [tuple(r)[1:] for r in Q.read_tuples(spark, str(tmp_path / "t")).collect()] == [(0, 1, 2, 3, 4), (1, 5, 6, 7, 8)]


def test_a_failed_run_is_an_error_whatever_is_read(spark, tmp_path):
    from strandframe.sources import text as T

    (tmp_path / "t.tsv").write_text("stage\twall_s\tuser_s\tsys_s\tmax_rss_kib\tthreads\texit\nsort\t1.5\t2\t0\t7\t4\t0\nmark\t1\t2\t0\t7\t4\t1\n")
    rows = T.read_timings(spark, str(tmp_path / "t.tsv"), T.STAGES)
    with pytest.raises(Exception, match="cleanly: mark"):
        rows.select("stage").collect()


def test_report_texts_of_junctions_distances_and_distributions(spark, tmp_path):
    import json

    from strandframe.operators import measures
    from strandframe.sources import render

    totals = spark.createDataFrame([("annotated", 7, 2), ("complete_novel", 1, 1), ("filtered", 3, 0)], "kind string, n_events bigint, n_junctions bigint")
    log = render.junction_log_text(totals)
    assert "Total splicing  Events:\t11\n" in log and "Novel Splicing Junctions:\t1\n" in log and "Filtered Splicing Events:\t3\n" in log
    render.write_histogram(spark.createDataFrame([(2, 5), (1, 9)], "occurrence bigint, n_keys bigint"), str(tmp_path / "h"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "h").glob("part-*"))) == "1\t9\n2\t5\n"
    values = spark.createDataFrame([("a", v) for v in (0, 1, 2, 3, 8, None, -4)], "k string, v bigint")
    shown = json.loads(render.distribution_json(measures.distribution(values, ["k"], "v"), ["k"]))
    assert shown == {"a": {"mean_value": 2.8, "q1_2": 2.0, "q9_10": 3.0, "q99_100": 3.0, "q1_1": 8.0, "log2_histogram": {"0": 1, "1": 1, "2": 2, "4": 1}}}
    a = spark.createDataFrame([(1, "x", None), (2, "y", "")], "i int, s string, t string")
    one = lambda df: df.first().checksum
    assert one(measures.checksum(a, "i", ["s", "t"])) == one(measures.checksum(a.repartition(3).orderBy("s"), "i", ["s", "t"]))
    swapped = spark.createDataFrame([(2, "x", None), (1, "y", "")], "i int, s string, t string")
    assert one(measures.checksum(a, "i", ["s", "t"])) != one(measures.checksum(swapped, "i", ["s", "t"]))
