"""Problem 7: altered, partial, reordered and shared passages."""

import math
import random

import pytest

from strandframe.llm import leaks as L

ITEM = ("Suppose a chandler finds the drawbridge ploughed while the rustic nursery stands walled: may the cooper of the brittle vineyard recover forty crowns? "
        "After seven winters the ferryman shuttered the hollow sluice, and every glazier of the tollgate shared forty parts of its frosted yield. "
        "The tidal hopyard had been surveyed by a steward whose blunt millrace adjoined the lunar beacon, although the factor kept a yearly orchard nearby.")
ZH = "若守塔人发现竹林已被重建，陡峭的磨坊又遭重建，他能否向石匠追讨17贯？过了55个冬天，铁匠才把低洼的渡口淹没，每名船工从石桥分得37份。"
PARTS = ITEM.split("? ")[0] + "?", ITEM.split("? ")[1].split(". ")[0] + ".", ITEM.split(". ")[1]
FILL = "The panel read the cargo list and found nothing that would help. " * 5


def typos(text, rate, seed):
    rng, words = random.Random(seed), text.split(" ")
    for i, w in enumerate(words):
        if len(w) > 4 and rng.random() < rate:
            k = rng.randrange(1, len(w) - 1)
            words[i] = w[:k] + rng.choice("xqz5") + w[k + 1 :]
    return " ".join(words)


def soft(text):
    return " ".join(w[:3] + "­" + w[3:] if len(w) > 5 else w for w in text.split(" "))


def shuffled(text):
    words = text.split(" ")
    random.Random(1).shuffle(words)
    return " ".join(words)


CASES = {
    "whole": (FILL + ITEM + FILL, True), "upper": (FILL + ITEM.upper().replace(" ", "\n") + FILL, True), "typos": (FILL + typos(ITEM, 0.2, 5), True),
    "soft": (soft(ITEM), True), "hyphen": (ITEM.replace("drawbridge", "draw-\nbridge").replace("millrace", "mill-\nrace"), True),
    "no stops": ("".join(c for c in ITEM if c not in ".,:?"), True), "two of three": (PARTS[0] + " " + PARTS[1], True),
    "matter between": (PARTS[0] + " " + FILL * 20 + PARTS[2] + FILL, True), "wide forms": ("".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in ITEM), True),
    "one sentence": (FILL + PARTS[1] + FILL, False), "other order": (shuffled(ITEM), False), "other text": (FILL * 9, False), "empty": ("", False),
}


@pytest.fixture(scope="module")
def found(spark):
    names = list(CASES)
    docs = spark.createDataFrame([(i, CASES[n][0], "en") for i, n in enumerate(names)] + [(90, None, None), (91, ZH.replace("，", " , ") + FILL, "x"), (92, ZH[:20], "x"),
                                                                                          (93, ITEM, "x"), (None, ITEM, "x")], "doc_id int, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, 1), (7, ITEM, 1), (8, ZH, 1), (9, None, 1), (10, "?!", 1), (None, ITEM, 1)], "item_id int, item_text string, doc_id int")
    rows = L.leaked(docs, items).collect()
    assert len({(r.item_id, r.doc_id) for r in rows}) == len(rows)
    return {(r.item_id, r.doc_id): r for r in rows}


@pytest.mark.parametrize("name", list(CASES))
def test_cases(found, name):
    assert ((7, list(CASES).index(name)) in found) == CASES[name][1]


def test_characters_and_kinds(found):
    assert (8, 91) in found and (8, 92) not in found and not any(k[0] in (9, 10) for k in found)
    assert found[7, 93].kind == "phrase" and found[7, 93].n_found == found[7, 93].n_words
    assert found[7, list(CASES).index("two of three")].kind == "proximity"


class Brute:
    """Every diagonal of every document, without any index."""

    def __init__(self, items):
        self.words = {i: w for i, t in items if (w := L.tokens(t or ""))}
        self.known = {w for ws in self.words.values() for w in ws}
        self.memo = {}

    def meaning(self, word):
        """The item word a word stands for, None for a word of no item."""
        if word not in self.memo:
            def cuts(w):
                return {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 4 else set()

            found = {word} & self.known
            if not found and len(word) > 4:
                letters = [t for t in self.known if t.isalpha()]
                found = {t for t in letters if word in cuts(t)}
                if len(found) != 1:
                    found |= {t for t in self.known if t in cuts(word)} | {t for t in letters if cuts(t) & cuts(word)}
            self.memo[word] = found.pop() if len(found) == 1 else None
        return self.memo[word]

    def runs(self, item, doc, cjk):
        out, least = [], min(len(item), 6 if cjk else 4)
        for line in range(-len(item) + 1, len(doc)):
            start = last = None
            for i in range(max(0, -line), min(len(item), len(doc) - line) + 1):
                right = i < min(len(item), len(doc) - line) and doc[i + line] == item[i]
                if right:
                    start, last = i if start is None else start, i
                between = [doc[k + line] for k in range((last or 0) + 1, i)] if start is not None else []
                stop = i >= min(len(item), len(doc) - line) or (not right and start is not None and (
                    i - last > (1 if cjk else 2) or (not cjk and doc[i + line] is not None)))
                if start is not None and stop and (i == len(item) or not right):
                    if last - start + 1 >= least:
                        out.append((start, start + line, last - start + 1))
                    start = last = None
        return out

    def pairs(self, docs):
        got = set()
        for d, text in docs:
            doc = [self.meaning(w) for w in L.tokens(text or "")]
            side = set(zip(doc, doc[1:]))
            for i, item in self.words.items():
                if len(set(item) & set(doc)) < 0.25 * len(set(item)):
                    continue
                near = sum(p in side for p in zip(item, item[1:])) if len(item) > 1 else 1
                need = min(max(math.ceil(len(item) / 4), 1), max(len(item) - 1, 1))
                if near >= need and L.in_order(self.runs(item, doc, L.by_character(item)))[0] >= 0.5 * len(item):
                    got.add((i, d))
        return got


def test_against_all_alignments(spark, sf):
    """The search finds what a search along every diagonal of every document finds."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    want = Brute([(r.item_id, r.item_text) for r in items.collect()]).pairs([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.item_id, r.doc_id) for r in L.leaked(docs, items).collect()} == want and want


def test_one_index_for_any_items(spark):
    """New items are searched on an index that was written without them, whatever is left out and however blocks are cut."""
    docs = [(i, CASES[n][0]) for i, n in enumerate(CASES)] + [(50, "ash"), (51, "an ash tree stands"), (52, "tree ash")]
    postings = L.index(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), block_tokens=60)
    assert postings.select("block").distinct().count() > 6
    rows = [(1, ITEM), (2, "ash"), (3, "ash tree"), (4, PARTS[1]), (5, "walled")]
    results = []
    for part, left_out in ((rows[:1], 0.5), (rows, 0.0), (rows, 0.5), (rows, 1.0)):
        got = {(r.item_id, r.doc_id): r.n_found for r in L.matches(postings, spark.createDataFrame(part, "item_id int, item_text string"), left_out=left_out).collect()}
        results.append(got)
    assert results[1] == results[2] == results[3]
    assert set(results[0]) == Brute(rows[:1]).pairs(docs) and set(results[1]) == Brute(rows).pairs(docs)
    assert {k for k in results[1] if k[0] in (2, 3)} == {(2, 50), (2, 51), (2, 52), (3, 51)}


def test_the_index_holds_every_word_and_place(spark):
    import numpy as np

    docs = [(i, CASES[n][0]) for i, n in enumerate(CASES)]
    rows = L.index(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    held = {}
    for block in {r.block for r in rows}:
        ids, starts, ends = np.frombuffer(b"".join(r.postings for r in rows if r.block == block and r.term == ""), "<i8").reshape(3, -1)
        for r in rows:
            if r.block == block and r.term:
                gaps = np.frombuffer(r.postings, "u1").reshape(4, -1).T.copy().view("<i4").ravel()
                assert len(gaps) == r.n
                for p in np.cumsum(gaps):
                    k = int(np.searchsorted(starts, p, "right")) - 1
                    assert p < ends[k]
                    held[int(ids[k]), int(p - starts[k])] = r.term
    assert held == {(d, k): w for d, t in docs for k, w in enumerate(L.tokens(t))}


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame([], "item_id int, item_text string")
    full = spark.createDataFrame([(1, ITEM)], "doc_id int, text string")
    assert L.leaked(docs, spark.createDataFrame([(1, ITEM)], "item_id int, item_text string")).count() == 0 and L.leaked(full, items).count() == 0


def test_passages_apart_foreign_pairs_and_common_halves(spark):
    """Halves in two passages, and halves that most documents hold, beside items that no document holds half of."""
    words = [f"{a}{b}" for a in ("bran", "cold", "dusk", "fern", "glen", "holt", "iron", "jade") for b in ("amber", "bison", "cedar", "delta", "ember", "flint", "grove", "heron", "inlet", "juniper")]
    item = " ".join(words)
    cases = {
        "two passages": (words[:20] + ["q1", "q2", "q3", "q4", "q5"] + words[20:40], True), "last half": (["q1"] * 9 + words[40:], True),
        "far passages": (words[5:15] + ["q1"] * 70 + words[30:40] + ["q1"] * 9 + words[45:55] + ["q1"] * 9 + words[70:], True),
        "gaps at every word": ([x for w in words[:42] for x in (w, "q1")], False), "fours": ([x for i in range(0, 80, 8) for x in [*words[i : i + 4], "q1", "q1", "q1"]], True),
        "too little": (words[:20] + ["q1"] * 5 + words[20:39], False), "shuffled": (shuffled(item).split(), False),
    }
    docs = [(i, " ".join(w)) for i, (w, _) in enumerate(cases.values())] + [(100 + i, " ".join(words[:40])) for i in range(9)]
    # One letter more or less makes no difference to a word: the second item has its own.
    items = spark.createDataFrame([(1, item), (2, " ".join(w[::-1] for w in words))], "item_id int, item_text string")
    got = {(r.item_id, r.doc_id): r for r in L.leaked(spark.createDataFrame(docs, "doc_id int, text string"), items).collect()}
    assert set(got) == {(1, i) for i, (_, held) in enumerate(cases.values()) if held} | {(1, 100 + i) for i in range(9)}
    assert (got[1, 0].n_found, got[1, 0].n_passages) == (40, 2)


@pytest.mark.parametrize("signs", [False, True])
def test_random_passages_against_all_alignments(spark, signs):
    rng = random.Random(5)
    known = [chr(0x4E00 + i) for i in range(30)] if signs else [a + b for a in "bcdfg" for b in ("a", "e", "i", "o", "u", "y")]
    items = [(i, " ".join(rng.choices(known, k=24))) for i in range(4)]
    docs = []
    for d in range(150):
        item, text = rng.choice(items)[1].split(), []
        for at in range(0, 24, 6):
            text += [w if rng.random() < 0.7 else rng.choice(["q", *known[:2]]) for w in item[at : at + 6]] * (rng.random() < 0.9) + ["q"] * rng.choice([0, 0, 1, 5])
        docs.append((d, " ".join(text)))
    want = Brute(items).pairs(docs)
    columns = "doc_id int, text string", "item_id int, item_text string"
    got = L.leaked(spark.createDataFrame(docs, columns[0]), spark.createDataFrame(items, columns[1])).collect()
    assert {(r.item_id, r.doc_id) for r in got} == want and 20 < len(want) < 150
