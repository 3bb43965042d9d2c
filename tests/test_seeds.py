"""Seed search against a look at every suffix."""

import random

from strandframe.operators import seeds

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def brute(query, refs):
    texts = [t.replace("N", ".") for s in refs for t in (s, s[::-1].translate(COMPLEMENT))]
    best, n = 0, sum(len(t) for t in texts)
    for size in range(1, len(query) + 1):
        found = sum(t.startswith(query[:size], i) for t in texts for i in range(len(t)))
        if not found:
            break
        best, n = size, found
    return best, n


def test_longest_matches_and_chains(spark):
    rng = random.Random(11)
    refs = ["".join(rng.choice("ACGT") for _ in range(300)) + "ACGT" * 12, "".join(rng.choice("ACGT") for _ in range(90)) + "NN" + "AAAAAAAAAAAAAAA"]
    queries = [refs[0][10:50], refs[0][290:330], refs[1][80:110], refs[0][100:140][::-1].translate(COMPLEMENT), "ACGT" * 8, "A" * 30, "NACGT", "G", refs[0][5:25] + refs[1][5:35]]
    queries += ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 40))) for _ in range(15)]
    asked = spark.createDataFrame([(i, q, 0) for i, q in enumerate(queries)] + [(99, None, 0), (98, "", 0)], "req_id int, query string, tid int")
    known = spark.createDataFrame([(i, s, "x") for i, s in enumerate(refs)] + [(7, None, "x")], "tid int, seq string, req_id string")
    for k, piece in ((4, 64), (12, 32768)):
        got = {r.req_id: (r.length, r.n_places) for r in seeds.search(asked, known, k, piece).collect()}
        assert got == {i: brute(q, refs) for i, q in enumerate(queries)}
    steps = {(r.req_id, r.step): (r.start, r.length, r.n_places) for r in seeds.chain(asked.where("req_id in (0, 8)"), known, steps=3, k=6).collect()}
    start, n = 0, 0
    while len(queries[8]) - start >= 5 and n < 3:
        length, places = brute(queries[8][start:], refs)
        assert steps[8, n] == (start, length, places)
        start, n = start + length, n + 1
    assert steps[0, 0] == (0, 40, 1) and (0, 1) not in steps


def test_frequent_words_are_spread_and_long_queries_refused(spark, monkeypatch):
    import pytest

    refs = ["A" * 200 + "C" + "A" * 60, "ACGT" * 30]
    queries = ["A" * 80, "A" * 80, "A" * 61 + "C", "ACGTACGTAA", "C" + "A" * 70]
    asked = spark.createDataFrame(list(enumerate(queries)), "req_id int, query string")
    known = spark.createDataFrame(list(enumerate(refs)), "tid int, seq string")
    monkeypatch.setattr(seeds, "HOT", 16)
    got = {r.req_id: (r.length, r.n_places) for r in seeds.search(asked, known, 4, 64).collect()}
    assert got == {i: brute(q, refs) for i, q in enumerate(queries)}
    with pytest.raises(Exception, match="at most"):
        seeds.search(spark.createDataFrame([(1, "A" * 5000)], "req_id int, query string"), known).collect()
