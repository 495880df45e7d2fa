"""Lines strung together by chance: a large connected part of few neighbours each goes to few places, and loses no link."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from sensorium.llm import line_dedup

from . import brute
from .test_contracts import case


def test_rows_of_a_chain(spark, monkeypatch):
    """A part that is a chain isn't copied for each of its tiles: its rows grow with its neighbours."""
    rnd = random.Random(21)
    line = [f"wort{k}" for k in range(40)]
    docs = []
    for k in range(160):
        line[k % 40] = f"neu{rnd.randrange(10**6)}"
        docs.append((k, " ".join(line)))
    rows, plain = [], line_dedup.verified

    def counted(lines, *how):
        rows.append(lines.count())
        return plain(lines, *how)

    monkeypatch.setattr(line_dedup, "verified", counted)
    got = {r.doc_id: set(r.removed) for r in line_dedup.decisions(case(spark, docs), part=4).collect()}
    gone = brute.line_dedup(docs)
    assert got == {d: gone.get(d, set()) for d, _ in docs} and len(gone) > 80
    sims = [brute.line_sims(t)[0] for _, t in docs]
    near = sum((a[0] ^ b[0]).bit_count() <= 8 and (a[1] ^ b[1]).bit_count() <= 7 for k, a in enumerate(sims) for b in sims[:k])
    assert sum(rows) <= 2 * near + 2 * len(docs)


def test_neighbours_meet_in_cells(spark):
    """Each pair of neighbours is in a place, with blocks that are compared there; a line is in no more places than it has neighbours."""
    rnd = np.random.default_rng(22)
    n, part = 400, 16
    flip = lambda x, most: x ^ sum(1 << int(b) for b in rnd.choice(63, rnd.integers(0, most + 1), replace=False))
    fps = [int(x) for x in rnd.integers(0, 1 << 62, 40)]
    while len(fps) < n:  # dense groups, and chains out of them
        fps.append(flip(fps[int(rnd.integers(0, 60) if rnd.random() < 0.5 else rnd.integers(0, len(fps)))] if len(fps) > 60 else fps[0], 6))
    lines = [(k, fp, 0, int(c)) for k, (fp, c) in enumerate(zip(fps, rnd.integers(60, 110, n), strict=True))]
    df = spark.createDataFrame(lines, "line long, fp long, more long, chars int")
    for tile in (1 << 17, 50):
        places: dict = {}
        for r in line_dedup.cells(df, 8, 13, 7, tile, part).collect():
            assert r.fp == fps[r.line] and r.t in (r.t1, r.t2)
            places.setdefault((r.root, r.t1, r.t2), {})[r.line] = r.t
        assert all(len(x) <= 2 * part for x in places.values())
        degree, met = [0] * n, 0
        for i, a, _, ca in lines:
            for j, b, _, cb in lines[:i]:
                if (a ^ b).bit_count() <= 8 and max(ca, cb) * 4 <= min(ca, cb) * 5:
                    degree[i] += 1
                    degree[j] += 1
                    together = [(t1, t2, x[i], x[j]) for (_, t1, t2), x in places.items() if i in x and j in x]
                    assert any(t1 == t2 or p != q for t1, t2, p, q in together)
                    met += 1
        assert met > 500
        if tile > n:
            assert all(sum(k in x for x in places.values()) <= d for k, d in enumerate(degree))


def test_batches_are_put_together():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3))], ["x"]) for k in range(0, 30, 3)]
    out = list(line_dedup.merged(iter([batches[0].slice(0, 0), *batches]), 7))
    assert [b.num_rows for b in out] == [9, 9, 9, 3] and [x for b in out for x in b.column(0).to_pylist()] == list(range(30))
    assert list(line_dedup.merged(iter([]), 7)) == list(line_dedup.merged(iter([batches[0].slice(0, 0)]), 7)) == []
