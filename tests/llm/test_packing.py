"""Problem 6: containers hold what they may, lose nothing, and waste little."""

import random
from collections import defaultdict

import pytest

from strandframe.llm import packing as P

SIZES = "size_id int, capacity_tokens int, doc_id int"


def check(rows, counts, capacities):
    for size_id, capacity in capacities.items():
        mine = [r for r in rows if r.size_id == size_id]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            fill[r.container_id] += r.n_tokens
            pieces[r.doc_id].append((r.tok_start, r.n_tokens, r.piece_no))
        assert max(fill.values(), default=0) <= capacity
        for doc, n in counts.items():
            if n:
                got = sorted(pieces[doc])
                assert [p[2] for p in got] == list(range(-(-n // capacity))) and sum(p[1] for p in got) == n
                assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and got[0][0] == 0
        rests = [n % capacity for n in counts.values() if n and n % capacity]
        # No packing has fewer containers than the volume needs, or than there are items over half of one.
        least = max(-(-sum(rests) // capacity), sum(2 * r > capacity for r in rests))
        yield len(fill), least + sum(n // capacity for n in counts.values() if n)


@pytest.mark.parametrize("shard", [50, 10_000])
def test_random_counts(spark, shard):
    rng = random.Random(shard)
    counts = {i: rng.choice([rng.randrange(1, 90), rng.randrange(1, 400), 0, 100, 2500]) for i in range(600)}
    df = spark.createDataFrame([(i, n, "x") for i, n in counts.items()] + [(9999, None, "x")], "doc_id bigint, n_tokens int, size_id string")
    capacities = {1: 100, 2: 700}
    sizes = spark.createDataFrame([(1, 100, 0), (2, 700, 0), (3, None, 0), (4, 0, 0)], SIZES)
    rows = P.assign(df, sizes, shard).collect()
    assert {r.size_id for r in rows} == {1, 2}
    for used, least in check(rows, counts, capacities):
        assert used <= 1.02 * least + 2 * -(-600 // shard)


def test_local_search_empties_bins():
    sizes = [6, 4, 6, 4, 5, 5, 3, 7]
    bins = [[0], [1, 4], [2], [3, 5], [6], [7]]
    found = P.local_search(sizes, bins, 10)
    assert sorted(i for b in found for i in b) == list(range(8)) and len(found) == 4
    assert P.local_search([], [], 10) == [] and P.local_search([10], [[0]], 10) == [[0]]


def test_search_never_lowers_the_fill():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randrange(1, 60) for _ in range(80)]
        bins = [[i] for i in range(80)]
        found = P.local_search(sizes, bins, 100)
        assert sorted(i for b in found for i in b) == list(range(80)) and all(sum(sizes[i] for i in b) <= 100 for b in found)
        assert sum(sum(sizes[i] for i in b) ** 2 for b in found) >= sum(s * s for s in sizes) and len(found) <= -(-sum(sizes) // 100) + 3
        best = P.best_fit(sizes, 100)
        assert sorted(i for b in best for i in b) == list(range(80)) and len(P.local_search(sizes, best, 100)) <= len(best)


def test_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 700, 0), (4, "<|endoftext|> plain", 0), (None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    assert set(counts) == {3, 4} and counts[3] >= 700 and counts[4] > 2
    placed = P.packed(docs, spark.createDataFrame([(1, 512, 0)], SIZES))
    assert sorted((r.doc_id, r.piece_no) for r in placed.collect()) == [(3, 0), (3, 1), (4, 0)]
    assert P.fill_report(placed, spark.createDataFrame([(1, 512, 0)], SIZES)).first().n_containers == 2
    assert P.packed(docs.limit(0), spark.createDataFrame([(1, 512, 0)], SIZES)).count() == 0


def test_checks_see_what_is_wrong(spark):
    sizes = spark.createDataFrame([(1, 10)], "size_id int, capacity_tokens int")
    counts = spark.createDataFrame([(1, 4), (2, 25), (3, 9), (4, 3)], "doc_id bigint, n_tokens bigint")
    schema = "size_id int, container_id string, doc_id bigint, piece_no int, n_tokens bigint, tok_start bigint"
    right = [(1, "a", 1, 0, 4, 0), (1, "b", 2, 0, 10, 0), (1, "c", 2, 1, 10, 10), (1, "a", 2, 2, 5, 20), (1, "d", 3, 0, 9, 0), (1, "e", 4, 0, 3, 0)]
    wrong = [(1, "a", 1, 0, 2, 0), (1, "b", 1, 1, 2, 2), (1, "b", 2, 0, 10, 0), (1, "c", 2, 1, 10, 9), (1, "a", 2, 2, 5, 20), (1, "d", 3, 0, 8, 0), (1, "e", 4, 0, 3, 0)]
    report = lambda rows: [tuple(r) for r in P.checks(spark.createDataFrame(rows, schema), counts, sizes).collect()]
    assert report(right) == [(1, 4, 0, 0, 0)] and report(wrong) == [(1, 4, 1, 1, 2)]


def test_more_rounds_never_need_more_containers(spark):
    counts = spark.range(3000).selectExpr("id AS doc_id", "id * 7919 % 487 + 20 AS n_tokens")
    sizes = spark.createDataFrame([(1, 512)], "size_id int, capacity_tokens int")
    used = [P.fill_report(P.assign(counts, sizes, 300, 200, rounds), sizes).first() for rounds in (0, 1, 3)]
    assert used[0].n_containers >= used[1].n_containers >= used[2].n_containers >= used[2].least_containers and used[2].fill > 0.97
