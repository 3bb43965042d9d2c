"""Alignment operators against row-at-a-time versions on random and hand-written rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandframe.functions import cigar, flags
from strandframe.operators import annotation, grouping, intervals, measures, reports

ALN = ("rec_idx bigint, qname string, flag int, tid int, pos int, mapq int, cigar string, mate_tid int, mate_pos int, tlen int, body_len int, "
       "ref_len int, nh int, start string")
EXONS = "ord_no bigint, chrom string, feature string, exon_start bigint, exon_end bigint, strand string, gene_id string"
REFS = "tid int, ref_name string, ref_length bigint"
CIGARS = ["10M", "3S7M", "7M3S", "4M20N6M", "2H3S10M4S5H", "10S", "4=6X", "3M1D2M1I4M", "*", None, "5M60N5M", "2M1P3M"]


def ops(c):
    return [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=XB])", c or "")]


def shape(c):
    o = ops(c)

    def clip(seq):
        n = 0
        for k, x in seq:
            if x not in "SH":
                break
            n += k
        return n

    return clip(o), clip(o[::-1]), sum(n for n, x in o if x in "MDN=X")


def spans(pos, c, emit, move):
    out = []
    for n, x in ops(c):
        if x in emit:
            out.append((pos, pos + n))
        if x in move:
            pos += n
    return out


def brute_duplicates(rows):
    ends, score, place = {}, {}, {}
    for r in rows:
        if r[2] & 0x904 == 0:
            lead, trail, ref = shape(r[6])
            ends[r[0]] = (r[3], r[4] + ref - 1 + trail if r[2] & 16 else r[4] - lead, bool(r[2] & 16))
            score[r[0]], place[r[0]] = r[10], (r[3], r[4], r[0])
    by_name = defaultdict(list)
    for r in sorted(rows):
        if r[0] in ends:
            by_name[r[1]].append(r)
    pairs, used = defaultdict(list), set()
    for group in by_name.values():
        a = next((r for r in group if r[2] & 0x40), None)
        b = next((r for r in group if r[2] & 0x80), None)
        if a and b and a[2] & 9 == 1 and b[2] & 9 == 1:
            used |= {a[0], b[0]}
            lo, hi = sorted([ends[a[0]], ends[b[0]]])
            pairs[lo, hi].append((-score[a[0]] - score[b[0]], min(place[a[0]], place[b[0]]), a[0], b[0]))
    out = {}
    for group in pairs.values():
        for i, p in enumerate(sorted(group)):
            out[p[2]] = out[p[3]] = (True, i > 0)
    taken = {e for k in pairs for e in k}
    singles = defaultdict(list)
    for i, e in ends.items():
        if i not in used:
            singles[e].append((-score[i], place[i], i))
    for e, group in singles.items():
        for k, s in enumerate(sorted(group)):
            out[s[2]] = (False, e in taken or k > 0)
    return out


def made(n, seed):
    rng = random.Random(seed)
    return [(i, f"q{rng.randrange(n // 2)}", rng.choice([67, 131, 83, 147, 73, 133, 4, 0, 16, 321, 2115, 0xC1, 1091]), rng.randrange(2), rng.randrange(40) * 5,
             rng.choice([0, 20, 30, 60, 255]), rng.choice(CIGARS), rng.randrange(2), rng.randrange(200), 0, rng.randrange(5), 1, rng.choice([None, 1, 2]), "x") for i in range(n)]


def test_hand_written_duplicates(spark):
    def r(i, name, flag, pos, q, c="10M", tid=0):
        return (i, name, flag, tid, pos, 60, c, 0, 0, 0, q, 1, 1, "x")

    rows = [r(0, "pair", 0x41, 100, 20), r(1, "pair", 0x81, 200, 20), r(2, "tie", 0x41, 100, 20), r(3, "tie", 0x81, 200, 20), r(4, "single", 0, 100, 40),
            r(5, "sec", 0x41, 300, 20), r(6, "sec", 0x181, 400, 20), r(7, "win", 0, 300, 30), r(8, "mu", 0x49, 500, 20), r(9, "mu", 0x85, 600, 20),
            r(10, "s2", 0, 500, 30), r(11, "rep", 0x49, 700, 20), r(12, "rep", 0x41, 700, 20), r(13, "rep", 0x81, 800, 20), r(14, "sup", 0x841, 100, 40),
            r(15, "both", 0xC1, 900, 20), r(16, "both2", 0xC1, 900, 20)]
    rows += [r(20 + i, f"clip{i}", f, 1000, 20, c) for i, (c, f) in enumerate([("3H2S10M4S5H", 0), ("10S", 16), ("4=6X", 0), ("20S10M", 16)])]
    got = {x.rec_idx: (x.is_pair, x.is_duplicate) for x in grouping.duplicates(spark.createDataFrame(rows, ALN), F.col("body_len")).collect()}
    assert got == brute_duplicates(rows)
    assert got[2] == (True, True) and got[4] == (False, True) and got[5] == (False, True) and 14 not in got and got[16] == (True, True)


@pytest.mark.parametrize("parts", [1, 5])
def test_random_duplicates_and_metrics(spark, parts):
    rows = made(400, parts)
    aln = spark.createDataFrame(rows, ALN).repartition(parts)
    dups = grouping.duplicates(aln, F.col("body_len"))
    want = brute_duplicates(rows)
    assert {x.rec_idx: (x.is_pair, x.is_duplicate) for x in dups.collect()} == want
    m = reports.duplication_metrics(aln, dups).first()
    assert m.unpaired_examined == sum(not p for p, _ in want.values()) and m.unpaired_duplicates == sum(d and not p for p, d in want.values())


def test_published_share(spark):
    dups = spark.sql("SELECT id AS rec_idx, id >= 1000 AS is_pair, (id < 755) OR (id BETWEEN 1000 AND 1199) AS is_duplicate FROM range(2000)")
    aln = spark.createDataFrame([], ALN)
    m = reports.duplication_metrics(aln, dups).first()
    assert (m.unpaired_examined, m.pairs_examined, m.unpaired_duplicates, m.pair_duplicates) == (1000, 500, 755, 100)
    assert m.percent_duplication == round((755 + 200) / 2000, 6)


def test_cigar_functions(spark):
    rows = [(i, 100, c) for i, c in enumerate(CIGARS)]
    o, p = cigar.ops(F.col("c")), F.col("p")
    got = spark.createDataFrame(rows, "i int, p int, c string").select(
        "c", cigar.leading_clip(o).alias("l"), cigar.trailing_clip(o).alias("t"), cigar.reference_length(o).alias("r"),
        cigar.coverage_blocks(p, o).alias("a"), cigar.qc_blocks(p, o).alias("b"), cigar.introns(p, o).alias("n")).collect()
    for r in got:
        pairs = lambda x: [tuple(y) for y in x]
        assert (r.l, r.t, r.r) == shape(r.c)
        assert pairs(r.a) == spans(100, r.c, "M=X", "MDN=X") and pairs(r.b) == spans(100, r.c, "M", "MDNS") and pairs(r.n) == spans(100, r.c, "N", "MDN=X")


def test_bins(spark):
    cases = [(0, 1, 4681), (16384, 16385, 4682), (0, 16385, 585), (0, 1 << 17 | 1, 73), (0, (1 << 26) + 1, 0), (1 << 26, (1 << 26) + 1, 4681 + 4096)]
    got = spark.createDataFrame(cases, "a bigint, b bigint, w int").select("w", flags.reg2bin(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.g == r.w for r in got)


def intervals_of(rng, n):
    return [(rng.randrange(2), s := rng.randrange(300), s + rng.randrange(0, 40)) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_interval_algebra(spark, width):
    rng = random.Random(width)
    a, b = intervals_of(rng, 60), intervals_of(rng, 50)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i int, k int, start int, end int")
    right = spark.createDataFrame([(j, *x) for j, x in enumerate(b)], "j int, k int, r_start int, r_end int")
    got = Counter((r.i, r.j) for r in intervals.overlap_join(left, right, ["k"], width).collect())
    assert got == Counter((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    points = left.select("i", "k", F.col("start").alias("point"))
    for closed in (True, False):
        got = Counter((r.i, r.j) for r in intervals.stab_join(points, right, ["k"], width=width, closed_start=closed).collect())
        assert got == Counter((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and (y[1] <= x[1] if closed else y[1] < x[1]) and x[1] < y[2])
    cover = lambda rows, k: {p for q, s, e in rows if q == k for p in range(s, e)}
    plain = right.select("k", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    for df, want in ((intervals.union(left, ["k"]), lambda k: cover(a, k)), (intervals.subtract(left, plain, ["k"]), lambda k: cover(a, k) - cover(b, k))):
        out = df.collect()
        for k in (0, 1):
            mine = sorted((r.start, r.end) for r in out if r.k == k)
            assert {p for s, e in mine for p in range(s, e)} == want(k) and all(x[1] < y[0] for x, y in zip(mine, mine[1:]))
    depth = intervals.depth(left, ["k"], width=64).collect()
    for k in (0, 1):
        count = Counter(p for q, s, e in a if q == k for p in range(s, e))
        mine = sorted((r.start, r.end, r.depth) for r in depth if r.k == k)
        assert {p: d for s, e, d in mine for p in range(s, e)} == dict(count) and all(x[1] < y[0] or x[2] != y[2] for x, y in zip(mine, mine[1:]))


def test_gene_votes_and_counts(spark):
    exons = [(0, "chr1", "exon", 0, 50, "+", "A"), (1, "chr1", "exon", 50, 60, "+", "A"), (2, "chr1", "exon", 40, 100, "-", "B"), (3, "CHR2", "exon", 0, 9, None, "C"),
             (4, "chr1", "CDS", 0, 9, "+", "D"), (5, "chr2", "exon", 0, 10, "+", None)]
    refs = spark.createDataFrame([(0, "chr1", 1000), (1, "chr2", 500)], REFS)
    ex = spark.createDataFrame(exons, EXONS)
    genes = annotation.gene_exons(ex, refs)
    assert {(r.gene_id, r.length) for r in annotation.gene_lengths(genes).collect()} == {("A", 60), ("B", 60)}
    assert {r.gene_id for r in annotation.gene_lengths(annotation.gene_exons(ex, refs, True)).collect()} == {"A", "B", "C"}

    def r(i, name, flag, pos, nh=1):
        return (i, name, flag, 0, pos, 60, "10M", 0, 0, 0, 1, 10, nh, "x")

    rows = [r(0, "a", 67, 0), r(1, "a", 131, 45), r(2, "b", 67, 45), r(3, "b", 131, 45), r(4, "c", 67, 90), r(5, "d", 67, 0, 2), r(6, "e", 67, 0), r(7, "e", 67, 5),
            r(8, "f", 0, 0), r(9, "g", 131, 500), r(10, "h", 67, 0), r(11, "h", 131, 95)]
    got = {x.gene_id: x.n_fragments for x in reports.gene_counts(spark.createDataFrame(rows, ALN), genes).collect()}
    assert got == {"A": 1, "B": 1}


def test_empty_alignments(spark):
    aln = spark.createDataFrame([], ALN).withColumn("is_dup", F.lit(False))
    refs, exons = spark.createDataFrame([(0, "chr1", 10)], REFS), spark.createDataFrame([], EXONS)
    genes = annotation.gene_exons(exons, refs)
    assert reports.flagstat(aln).first().total == 0 and reports.bam_stat(aln).first().unique == 0
    assert [r.unmapped for r in reports.idxstats(aln, refs).collect()] == [0, 0]
    assert grouping.duplicates(aln, F.col("body_len")).count() == 0 and reports.coverage(aln, refs).count() == 0
    assert {r.tags for r in reports.read_distribution(aln, genes).collect()} == {0}
    assert reports.infer_experiment(aln, genes).count() == 0 and reports.inner_distance(aln, genes).count() == 100
    assert reports.duplication_matrix(aln, genes).count() == 0 and reports.alignment_qc(aln, genes).first().proper_pairs == 0


def test_ranks_quantiles_and_captures(spark):
    df = spark.createDataFrame([(i, (i * 7) % 50) for i in range(200)], "i int, v int").repartition(6)
    ranked = grouping.global_rank(df, ["v", "i"]).collect()
    assert [r.i for r in sorted(ranked, key=lambda r: r["rank"])] == [i for v, i in sorted(((i * 7) % 50, i) for i in range(200))]
    for most in (0, 1, 77, 200, 900, None):
        capped = grouping.ordered_cap(df, ["v", "i"], most)
        assert sorted((r.v, r.i) for r in capped.collect()) == sorted(((i * 7) % 50, i) for i in range(200))[:most]
        assert capped.columns == ["i", "v"] and "TakeOrdered" not in capped._jdf.queryExecution().toString()
    values = sorted((i * 7) % 50 for i in range(200))
    q = grouping.lower_quantiles(df.withColumn("k", F.lit(1)), ["k"], "v", [(0, 1), (1, 3), (1, 1)]).first()
    assert (q.n_values, q.q0_1, q.q1_3, q.q1_1) == (200, values[0], values[199 // 3], values[-1])
    rows = [("w", "a", 0), ("w", "a", 1), ("w", "b", 2), ("w", "b", 3), ("w", "b", 4), ("w", "c", 5), ("x", "d", 6)]
    got = measures.bounded_capture(spark.createDataFrame(rows, "w string, r string, o int"), "w", "r", "o", 4).collect()
    assert {(r.w, r.r, r.running) for r in got} == {("w", "a", 2), ("x", "d", 1)}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {tuple(r) for r in measures.multiset_difference(a, b).collect()} == {(1, "left"), (3, "right")}


def test_quality_scores(spark):
    rows = spark.createDataFrame([(1, [10, 15, 40]), (2, []), (3, None), (4, [14])], "i int, qual array<smallint>")
    got = {r.i: r.s for r in rows.select("i", grouping.quality_score(F.col("qual")).alias("s")).collect()}
    assert got == {1: 55, 2: 0, 3: 0, 4: 0}


def test_matrix_pairs_by_hit_number(spark):
    genes = spark.createDataFrame([(g, 0, "+", s, s + 50, s) for g, s in (("a", 0), ("b", 1000), ("c", 2000))], "gene_id string, tid int, strand string, start bigint, end bigint, ord_no bigint")

    def r(i, flag, pos, mate, hi, dup=False):
        return (i, "n", flag, 0, pos, "10M", 2, mate, dup, hi)

    # By mate position the mates of a and b would be crossed; by hit number each meets its own.
    rows = [r(1, 65, 0, 1000, 1), r(2, 65, 1000, 0, 2), r(3, 129, 5, 0, 1), r(4, 129, 1005, 1000, 2), r(5, 65, 2000, 0, 3, True)]
    schema = "rec_idx bigint, qname string, flag int, tid int, pos int, cigar string, nh int, mate_pos int, is_dup boolean, hi int"
    count = lambda rows: {x.gene_id: (x.all_counts_multi, x.filtered_counts_multi) for x in reports.duplication_matrix(spark.createDataFrame(rows, schema), genes).collect()}
    assert count(rows) == {"a": (1, 1), "b": (1, 1), "c": (1, 0)}
    # A record without the number that only one mode leaves out makes the others fall back to the mate position.
    assert count(rows[:4] + [r(5, 65, 2000, 0, None, True)]) == {"a": (1, 1), "b": (0, 1), "c": (0, 0)}
