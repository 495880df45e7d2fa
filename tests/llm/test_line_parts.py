"""Parts of the line dedup: features hashed once, and links found by words before the exact edit distance."""

from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from sensorium.llm import line_dedup

from . import brute


def test_features_are_hashed_once(monkeypatch):
    rnd = random.Random(3)
    words = [f"wörd{k}".encode() for k in range(40)]
    lists = [[rnd.choice(words) for _ in range(rnd.choice((1, 5, 30, 700)))] for _ in range(60)]
    lists.append([str(k).encode() for k in range(600)])  # more than 255 different ones
    asked = []
    digest = line_dedup.xxhash.xxh3_128_digest
    monkeypatch.setattr(line_dedup, "xxhash", SimpleNamespace(xxh3_128_digest=lambda x: asked.append(x) or digest(x)))
    h, n = line_dedup.feature_hashes(pa.array(lists, pa.list_(pa.binary())))
    assert n.tolist() == [len(set(x)) for x in lists]
    assert sorted(asked) == sorted({x for some in lists for x in some})
    fp, more = line_dedup.simhashes(h, n)
    want = [brute.line_sims(" ".join(x.decode() for x in some))[0] for some in lists if len(some) >= 9]
    assert [x for x, some in zip(zip(fp.tolist(), more.tolist(), strict=True), lists, strict=True) if len(some) >= 9] == want


def test_alignment_of_words_never_says_too_much():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7)))
    seen = [0, 0]
    for _ in range(1500):
        a = [word() for _ in range(rnd.randrange(1, 12))]
        b = list(a)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(3)] = [word() for _ in range(rnd.randrange(3))]
        b = b or [word()]
        x, y = " ".join(a), " ".join(b)
        apart, most = brute.edits(x, y), rnd.randrange(12)
        assert line_dedup.within(x, y, most) == (apart <= most)
        sure = line_dedup.surely_within(a, b, most)
        assert not sure or apart <= most
        seen[0] += sure
        seen[1] += apart <= most
    assert seen[0] > 0.6 * seen[1]  # the exact check is for the rest


def test_lines_of_texts(monkeypatch):
    """Lines split byte by byte for all texts at once are those of a plain split, however few bytes are split at once."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aB1é这\u0130 .\t\n\r\u00a0\U0001f600") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += [None, "", "\n\n", "Ein \t Wort", "a", " é", "x" * 500 + " y"]
    want = []
    for r, t in enumerate(texts):
        for no, line in enumerate((t or "").lower().split("\n")):
            if norm := re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", line).strip(" "):
                want.append((r, no, norm.encode(), len(norm), norm.split(" "), [norm[k : k + 2] for k in range(max(1, len(norm) - 1))]))
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(line_dedup, "SPLIT_AT_ONCE", most)
        got = []
        for x in line_dedup.lines_of(texts):
            every = np.ones(len(x.rows), bool)
            words, pairs = ([[f.decode() for f in some] for some in made(every).to_pylist()] for made in (x.words, x.char_pairs))
            got += zip(x.rows.tolist(), x.nos.tolist(), x.norms(), x.chars.tolist(), words, pairs, strict=True)
            odd = np.arange(len(x.rows)) % 2 == 1
            assert x.words(odd).to_pylist() == x.words(every).to_pylist()[1::2] and x.char_pairs(odd).to_pylist() == x.char_pairs(every).to_pylist()[1::2]
            assert x.n_words.tolist() == list(map(len, words))
        assert got == want


def test_bucket_rows_are_dealt_in_packs(spark):
    """What a batch has for a bucket is one row, not one for each line; large buckets go to each pair of their tiles."""
    rnd = np.random.default_rng(6)
    n, tile = 4000, 8
    fp = rnd.integers(-(1 << 62), 1 << 62, n)
    fp[1::2] = fp[::2] ^ (1 << rnd.integers(0, 64, n // 2).astype(np.uint64)).astype(np.int64)
    rows = [(int(x), 5, None if k % 3 else int(x), None if k % 3 else 5, 100) for k, x in enumerate(fp)]
    classes = spark.createDataFrame(rows, "a long, ax long, b long, bx long, chars int").coalesce(1).cache()
    buckets = line_dedup.Buckets(8, 13)
    key, of = buckets.rows(pa.RecordBatch.from_pylist([r.asDict() for r in classes.collect()], classes_schema))
    bucket = Counter((key >> buckets.low).tolist())
    large = buckets.large(classes, tile)
    assert dict(zip(*(x.tolist() for x in large), strict=True)) == {b: -(-m // tile) for b, m in bucket.items() if m > tile}
    for some in ((np.empty(0, np.int64),) * 2, large):
        found = buckets.dealt(classes, tile, some).collect()
        assert len(found) <= sum((m + 1) * m // 2 for m in (-(-m // tile) if len(some[0]) else 1 for m in bucket.values()))
        got = Counter((r.t, k, f) for r in found for k, f in zip(np.frombuffer(r.keys, np.int64).tolist(), np.frombuffer(r.fps, np.int64).tolist(), strict=True))
        assert all(k >> buckets.low == r.bucket for r in found for k in np.frombuffer(r.keys, np.int64).tolist())
        if not len(some[0]):
            assert got == Counter((0, k, f) for k, f in zip(key.tolist(), of.tolist(), strict=True)) and len(found) < len(key) / 2
        else:  # each two rows of a bucket meet
            places: dict = {}
            for t, k, f in got:
                places.setdefault((k, f), set()).add(t)
            by: dict = {}
            for x in places:
                by.setdefault(x[0] >> buckets.low, []).append(x)
            assert all(places[x] & places[y] for some_rows in list(by.values())[:200] for x in some_rows for y in some_rows)


classes_schema = pa.schema([(c, pa.int64()) for c in ("a", "ax", "b", "bx")] + [("chars", pa.int32())])


def test_neighbours_are_all_found():
    rnd = np.random.default_rng(7)
    for n, at_once in ((2, 8), (60, 16), (300, 1 << 15), (300, 1000)):
        fp = rnd.integers(0, 1 << 6, n).astype(np.uint64) << np.uint64(3)
        more, chars = rnd.integers(0, 1 << 6, n), np.sort(rnd.integers(1, 40, n))
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if chars[j] * 4 <= chars[i] * 5 and int(fp[i] ^ fp[j]).bit_count() <= 2 and int(more[i] ^ more[j]).bit_count() <= 2}
        found = [(i, j) for x, y in line_dedup.neighbours(fp, more, chars, 2, 2, at_once) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want
