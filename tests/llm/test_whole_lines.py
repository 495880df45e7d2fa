"""Line dedup against a brute force over all pairs of lines, and its recall against the edit bound alone."""

from __future__ import annotations

import random

from sensorium.llm import line_dedup

from . import brute
from .test_contracts import case


def check(spark, docs, least, **how):
    """The lines that go; at least such a share of those that would go by the edit bound alone."""
    gone = brute.line_dedup(docs)
    got = {r.doc_id: set(r.removed) for r in line_dedup.decisions(case(spark, docs), **how).collect()}
    assert got == {d: gone.get(d, set()) for d, _ in docs}
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(case(spark, docs)).collect()}
    assert all(kept[d] == (t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ()))) for d, t in docs)
    every = brute.line_dedup(docs, near=lambda a, b: True)
    assert sum(map(len, gone.values())) >= least * sum(map(len, every.values()))
    return gone


def test_one_word_changed(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9)))
    docs = []
    for k in range(48):
        line = [word() for _ in range((5, 10, 20, 40)[k % 4])]
        near = list(line)
        at = min(range(len(near)), key=lambda i: len(near[i])) if len(near) == 5 else rnd.randrange(len(near))
        near[at] = "".join(rnd.choice("abcdefghij") for _ in near[at])
        docs += [(k, " ".join(line)), (100 + k, "Zeile eins\n" * (k == 0) + " ".join(near))]
    check(spark, docs, 0.6)


def test_dense_group_and_chain(spark):
    rnd = random.Random(12)
    base = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood"
    group = [base[:k] + rnd.choice("xyz") + base[k + 1 :] for k in range(40)]
    chain = ["abcdefghijklmnopqrstuvwxyz0123456789" * 2]
    for k in range(5):  # the ends of the chain are further apart than the bound
        chain.append(chain[-1][: 12 * k] + "q" * 9 + chain[-1][12 * k + 9 :])
    docs = [(k, x) for k, x in enumerate(group + chain)]
    # small tiles: each pair of tiles is compared by itself
    check(spark, docs, 0.5, tile=4, part=4)


def test_short_edits(spark):
    rnd = random.Random(14)
    docs = []
    for k in range(150):
        x = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 17)))
        y = list(x)  # at most three characters longer
        for _ in range(len(x) // 5):
            at = rnd.randrange(len(y))
            y[at : at + rnd.randrange(2)] = rnd.choice(("", "z", "y"))
        docs += [(k, x), (1000 + k, "".join(y))]
    check(spark, docs, 0.2)


def test_lines_without_three_words(spark):
    cjk = "这是一个没有空格的中文句子它很长并且在许多文件里重复出现"
    docs = [
        (1, "Home\nRead more\n\n" + cjk + "\nHome"), (2, "home!\nread  more\n \n" + cjk[:-1] + "了"), (3, "Hone\nจนกว่าจะถึงวันพรุ่งนี้\n42"), (4, "จนกว่าจะถึงวันพรุ่งนี้\n42\n43"),
        (5, "contact-us\nContact us"), (6, "contakt us\nxy"), (7, None), (8, ""), (9, "\n\n"),
    ]
    gone = check(spark, docs, 0.5)
    assert gone[2] >= {0, 1} and gone[4] >= {0, 1} and gone[1] == {4} and 9 not in gone


def test_smaller_radius(spark):
    rnd = random.Random(15)
    words = [f"w{k}x" for k in range(200)]
    docs = []
    for k in range(60):
        line = rnd.sample(words, 30)
        near = [*line[:-1], "other"] if k % 2 else line[:-6]
        docs += [(k, " ".join(line)), (100 + k, " ".join(near))]
    gone = brute.line_dedup(docs, radius=3)
    got = {r.doc_id: set(r.removed) for r in line_dedup.decisions(case(spark, docs), radius=3, blocks=6).collect()}
    assert got == {d: gone.get(d, set()) for d, _ in docs} and gone
