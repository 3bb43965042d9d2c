"""Problem 8: boundaries by script, and chunked against whole runs."""

import itertools
import random

import numpy as np
import pytest

from strandframe.llm import sentences as S


def split(text):
    return [text[a:b] for a, b in S.units(text)]


@pytest.mark.parametrize("pieces", [
    ["Dr. Hale paid $4,000.50 under clause 4.2, i.e. late.", "He left at 6 p.m. on 3 May.", "Why?!", "No one knew."],
    ['She said, "It was dark. We left," and sat.', 'It ends: "Send it back."', "No reply."],
    ['He asked, "Who holds it?" but nobody replied.', "See A. B. Cole and J. Dane."],
    ["It belongs to Orr Holdings Inc.", "On appeal we agree.", "See Orr & Co. v. Lee, Orr & Co. (2004) 57 Wst. Rep. 177."],
    ["Am 3. und 14. Verhandlungstag blieb er aus, vgl. Bl. 39 d. A.", "Der Preis stieg im Jahr 1999.", "Er sagte: „Ja. Es war so.“", "Ende."],
    ["Cet argument ne convainc pas !", "Le témoin : « Rien vu. Nuit. »", "Selon l'art. 5, al. 7, oui.", "Prix en couronnes env.", "Le bail."],
    ["Он был в г. Велемост 6 июля 2001 года.", "Он пояснил: «Я не видел. Темно.»", "Сумма 4,5 млн руб.", "Кто?"],
    ["证人答道：“没有。天黑了。”", "该主张不能成立！", "交付……因此不产生效力。"],
    ["証人は「見ていない。」と述べた。", "採用できない！", "受け取ったのか？"],
    ['गवाह डॉ. राव ने कहा, "नहीं। रात थी।"', "क्या मिला?"],
    ["قال: «لم أر. كان الليل.»", "انظر ص. 146 من الملف.", "هل تسلمت؟"],
    ["¿Quién recibió el plano?", "¡No consta!", "Véase pág. 3 y núm. 4."],
])
def test_pieces(pieces):
    joined = "" if ord(pieces[0][0]) > 0x2E80 else " "
    text = joined.join(pieces)
    assert split(text) == pieces
    assert split(text.replace(" ", "\n")) == [p.replace(" ", "\n") for p in pieces]


def test_layout():
    text = "High Bench\n\nOrr v. Lee\n\nT-4/00\n\n(5) One. Two\n\nHigh Bench - T-4/00 - Page 2 of 5\n\ngoes on.\n\n1. Am Ende.  \n"
    assert split(text) == ["High Bench", "Orr v. Lee", "T-4/00", "(5) One.", "Two", "High Bench - T-4/00 - Page 2 of 5", "goes on.", "1. Am Ende."]
    cut = 'He said, "It was\n\nHigh Bench - T-4/00 - Page 2 of 5\n\nfiled. We closed it," and left. Then.'
    assert split(cut)[-2:] == ['filed. We closed it," and left.', "Then."]
    assert split("ศาลเห็นว่า ข้อ 5 ตัน ผิด") == ["ศาลเห็นว่า", "ข้อ 5 ตัน", "ผิด"]
    assert split("it.The next.他说。Then") == ["it.", "The next.", "他说。", "Then"]
    assert split("He told X*** The end. Der Weber am [REDACTED] Speicher ruht (…) Ende.") == ["He told X***", "The end.", "Der Weber am [REDACTED] Speicher ruht (…)", "Ende."]
    assert split("費用はUmmwicket Timber Ltd.の負担とする。次。") == ["費用はUmmwicket Timber Ltd.の負担とする。", "次。"]
    assert split("It left for Orr & Co. (see p. 16). Then (…) paid Orr Ltd. (…) left. Orr Inc. [2019] 3. Orr Inc. [REDACTED] left.") == [
        "It left for Orr & Co. (see p. 16).", "Then (…) paid Orr Ltd.", "(…) left.", "Orr Inc. [2019] 3.", "Orr Inc.", "[REDACTED] left."]
    assert split("no stop at all") == ["no stop at all"] and split("") == [] and split(" \n ") == []


def test_the_machine_writes_what_the_first_fitting_rule_says():
    for tape in itertools.product(S.KINDS, S.CLOSERS, S.GAPS, S.FOLLOWS, S.WORDS):
        want = next(r[5] for r in S.RULES if all(r[k] is None or tape[k] in r[k] for k in range(5)))
        state = S.MACHINE[tape[:2]]
        for symbol in tape[2:]:
            state = state if isinstance(state, str) else state[symbol]
        assert state == S.OUTPUT[tape[1], want]


def test_stops_before_unusual_characters():
    assert split("See Ⅳ. Ⓓ one. Left at 3.Ⓓ xy. Sold by Orr Ltd. 社は。") == ["See Ⅳ.", "Ⓓ one.", "Left at 3.Ⓓ xy.", "Sold by Orr Ltd. 社は。"]


def test_scan_composes_like_a_loop():
    rng = np.random.default_rng(1)
    parts = ["".join(rng.choice(list("SSTOOOCCEBH"), rng.integers(0, 30))) for _ in range(13)]
    scan = S.compose(np.array([S.transition(p) for p in parts]))
    for start in (0, 1, 7, 50):
        depth = start
        for part, (a, b) in zip(parts, scan):
            for symbol in part:
                (c, d), _ = S.STEP[symbol]
                depth = max(depth + c, d)
            assert depth == max(start + a, b)


def test_chunks_give_the_same_units(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").cache()
    whole = {tuple(r) for r in S.sentence_units(docs, chunk=10**9).collect()}
    for chunk in (700, 5000):
        rows = S.sentence_units(docs, chunk=chunk).collect()
        assert len(rows) == len(whole) and {tuple(r) for r in rows} == whole


def test_seams_long_runs_and_deep_quotations(spark):
    rng, page = random.Random(3), "\n\nHigh Bench - T-4/00 - Page 2 of 5\n\n"
    some = ['He said "', "«", "»", "“", "”", " Dr. Orr ", " no. 5", ". ", "! ", "one two three", "\n\n", page, "他说。", "ศาล เห็น", " █ The ", "\n", " (…) Ende"]
    texts = [
        "One two. Three four." + " " * 70_000, "One two. Three" + " " * 70_000 + "four. Five.", "\n" * 70_000 + "One. Two.", "One" + "." * 70_000 + " Two. Three.", "█" * 70_000 + " The end. So.",
        "«" * 9 + "One. Two. " * 900 + "»" * 9 + " Three. Four.", "“" * 5000 + "One. Two. " + "”" * 5000 + " Three. Four.", "x" * 70_000, "a. " * 30_000,
    ] + ["".join(rng.choices(some, k=900)) for _ in range(25)] + ["".join(w * rng.choice([1, 1, 1, 300]) for w in rng.choices(some, k=120)) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {(d, a, b) for d, t in enumerate(texts) for a, b in S.units(t)}
    for chunk in (500, 3000, 32_768):
        rows = S.sentence_units(docs, chunk=chunk).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert (0, 9, 20) in want and (1, 9, 70_019) in want


def test_every_character_is_in_one_unit(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect():
        spans = S.units(r.text)
        assert all(a < b and not r.text[a].isspace() and not r.text[b - 1].isspace() for a, b in spans)
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
        assert sum(len(r.text[a:b]) for a, b in spans) - sum(c.isspace() for a, b in spans for c in r.text[a:b]) == sum(not c.isspace() for c in r.text)


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "  ", 0), (4, "Aa bb. Cc dd.", 0), (None, "Aa.", 0)]
    got = S.sentence_units(spark.createDataFrame(rows, "doc_id int, text string, sent_start int"))
    assert sorted(map(tuple, got.collect())) == [(4, 0, 6), (4, 7, 13)]
    assert S.sentence_units(spark.createDataFrame([], "doc_id int, text string")).count() == 0
