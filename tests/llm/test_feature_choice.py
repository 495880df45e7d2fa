"""op10's choice of features against counting all of them, and its held-out quality."""

from __future__ import annotations

import math
import random
from collections import Counter

from sensorium.llm import queries, toxicity


def brute_choice(rows, most):
    counts = [Counter(), Counter()]
    for text, y in rows:
        w = toxicity.words(text)
        held = Counter(f for x in w for f in [f"{x.decode()}$", *(x.decode()[:k] for k in toxicity.PREFIXES if len(x.decode()) > k)])
        for f, n in held.items():
            counts[y].update([(f, 0)] + [(f, 1)] * (n >= 2) + [(f, 2)] * (n * toxicity.DENSE >= len(w)))
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    gains = []
    for f in {*counts[0], *counts[1]}:
        a, have = counts[1][f], counts[1][f] + counts[0][f]
        if have < toxicity.LEAST_DOCS or have == len(rows):
            continue
        table = [[a, have - a], [n1 - a, n0 - have + a]]
        chi = sum((table[i][j] - (e := sum(table[i]) * (table[0][j] + table[1][j]) / len(rows))) ** 2 / e for i in (0, 1) for j in (0, 1))
        if chi >= toxicity.LEAST_GAIN:
            gains.append((-chi, *f))
    return [(f, level) for _, f, level in sorted(gains)[:most]]


def test_choice_of_features(spark):
    rnd = random.Random(9)
    words = [f"w{chr(97 + k)}{chr(97 + k // 3)}ö" for k in range(20)]
    rows = []
    for k in range(500):
        y = k % 5 == 0
        bad = ["vilest", "Vile", "nasty"][: rnd.randrange(4)] if y and rnd.random() < 0.8 else []
        rows.append((" ".join(rnd.choices(words[: 8 if y else 20], k=rnd.randrange(1, 30)) + bad).encode(), int(y)))
    frame = spark.createDataFrame([(bytearray(t), y) for t, y in rows], "text binary, y int").repartition(3)
    want = brute_choice(rows, 10**6)
    got = toxicity.choose(frame, 10**6)
    assert len(want) > 15 and sorted(got) == sorted(want)
    few = toxicity.choose(frame, 7)
    assert len(few) == 7 and set(few) <= set(want) and few == got[:7]
    assert toxicity.choose(frame.where("y = 0"), 10) == [] == toxicity.choose(frame.limit(0), 10)


def test_held_out_quality(spark):
    """Precision, recall and ranking on rows that weren't learned from."""
    found = queries.op10_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    got = found.join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    hit = sum(r.toxic for r in got if r.predicted)
    assert len(got) > 200 and hit >= 0.95 * sum(r.predicted for r in got) and hit >= 0.92 * sum(r.toxic for r in got)
    by_score = sorted(got, key=lambda r: r.score)
    n1 = sum(r.toxic for r in got)
    places = sum(k + 1 for k, r in enumerate(by_score) if r.toxic)
    assert (places - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1)) > 0.97
    assert all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in got)
