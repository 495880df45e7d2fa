"""op12: automata and phrases against plain substring search, cases, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

from pyspark.sql import functions as F

from sensorium.llm import langid, queries

SF = "/root/testdata/sf0.01"


def brute_phrases(labelled, text):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in labelled:
            size += 1
        at += size
        n += 1
    return n


def test_automaton_has_all_substrings_and_no_others():
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice("ab c") for _ in range(rnd.randrange(1, 40)))
        start = langid.automaton(text)
        for _ in range(60):
            x = "".join(rnd.choice("ab cd") for _ in range(rnd.randrange(1, 7)))
            node = start
            for c in x:
                node = node.get(c) if node is not None else None
            assert (node is not None) == (x in text)


def test_phrases():
    rnd = random.Random(5)
    for _ in range(300):
        labelled, text = ("".join(rnd.choice("abc de") for _ in range(rnd.randrange(1, 60))) for _ in range(2))
        text += rnd.choice(["", "zz", "é", " a"])
        assert langid.phrases(langid.automaton(labelled), text) == brute_phrases(labelled, text)
    assert langid.phrases(langid.automaton("ab"), "") == 0


def test_predictions(spark):
    given = {"en": "the cat sat on the mat and the dog was there with them all day", "de": "der hund und die katze sind nicht in dem haus gewesen heute", "": "日本語 の 文章 です"}
    rows = [(1, None), (2, ""), (3, "123 ... 456"), (4, "The dog, and the cat!"), (4, "Der Hund und die Katze"), (None, "日本語の文章"), (5, "THE\nDOG" * 20_000), (6, "́́"), (7, "a"), (8, "Ж")]
    frame = spark.createDataFrame([(d, t, "x", "y", 1.0) for d, t in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = sorted(map(tuple, langid.predictions(frame, given).collect()), key=repr)
    automata = {x: langid.letters(t) for x, t in given.items()}
    want = []
    for d, t in rows:
        text = langid.letters(t)
        if not text:
            want.append((d, "und", 0.0))
            continue
        bits = {x: brute_phrases(given[x], text) * math.log2(len(given[x])) / len(text) for x in sorted(given)}
        best = min(bits, key=bits.get)
        want.append((d, best, 1 / sum(2 ** (bits[best] - b) for b in bits.values())))
    assert got == sorted(want, key=repr) and set(automata)
    assert {r[1] for r in got if r[0] in (1, 2, 3, 6)} == {"und"} and {r[1] for r in got if r[0] == 4} == {"en", "de"}
    assert {r[1] for r in langid.predictions(frame, {}).collect()} == {"und"}
    assert langid.predictions(frame.limit(0), given).count() == 0


def test_sample_is_bounded_and_from_learned_rows_only(spark):
    rows = [(k, f"{'eins zwei drei' if k % 3 else 'one two three'} {'wort ' * (k % 50)}", None if k % 11 == 0 else "de" if k % 3 else "en") for k in range(2000)] + [(None, "kein wort", "xx"), (1, None, "yy"), (2, "12 34", "zz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    drawn = langid.sample(frame, F.col("doc_id") % 2 == 0, passages=30, length=20)
    assert set(drawn) == {"de", "en"}
    assert all(len(x.split("\n")) == 30 and max(map(len, x.split("\n"))) <= 22 for x in drawn.values())
    assert drawn == langid.sample(frame.repartition(2), F.col("doc_id") % 2 == 0, passages=30, length=20)
    assert sum(map(len, langid.sample(frame, F.lit(True), passages=30, length=20, total=200).values())) <= 400
    assert langid.sample(frame.limit(0), F.lit(True)) == {}


def test_held_out_accuracy(spark):
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(langs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == langs[r.doc_id][0] for r in held) / len(held) >= 0.96
    assert all((r.lang_pred == "und") == (not langid.letters(langs[r.doc_id][1])) for r in got)
