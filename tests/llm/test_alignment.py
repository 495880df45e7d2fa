"""op11 against a restatement with the two libraries, byte by byte."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sensorium.llm import alignment, queries
from sensorium.llm.common import lots

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute(rows, a, sp):
    table = alignment.byte_alphabet()
    assert sorted(table.values()) == list(range(256))

    def b_bytes(k):
        p = sp.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode()

    docs = []
    for d, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        xs, ys = [bytes(table[c] for c in a.id_to_token(k)) for k in x], [b_bytes(k) for k in y]
        if not x or b"".join(xs) != f" {text}".encode() or b"".join(ys) != f" {text}".encode():
            docs.append((d, [], [], []))
            continue
        ends = [{*np.cumsum([*map(len, s)]).tolist()} for s in (xs, ys)]
        cuts = sorted(ends[0] & ends[1])
        found, at = [([], []) for _ in cuts], 0
        for which, (ids, parts) in enumerate(((x, xs), (y, ys))):
            at = 0
            for k, p in zip(ids, parts, strict=True):
                at += len(p)
                found[np.searchsorted(cuts, at)][which].append(k)
        docs.append((d, x, y, found))
    count = Counter()
    for *_, found in docs:
        count.update({(i, j) for g, h in found for i in g for j in h})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for d, x, y, found in docs:
        links = [(i, j) for g, h in found for i in g for j in h]
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in found)
        yield d, len(x), len(y), len(found), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if x else ""


def rows():
    rnd = random.Random(3)
    odd = ["<|endoftext|> in text", "don't we'll it's  two  spaces\n\n\nlines\r\nand\ttabs \n x", " lead", "trail ", "▁ mark", "a▁b", "<s> </s> <unk> <0x41>", "日本語 ñandú 😀😀 é́", "x" * 3000, "ab" * 2000, "aaa bbb " * 500, "\x00\x1f\x85　 z", " ", "\n", "  ", "1234567 12,5 3.14. end.Next,one;two:three!four?five", "…“quoted”—dash's", "A\nB\n\nC. D", "word.\nWord\nx .\n y z q", "ſ's 'S 'sit 'llama"]
    out = [(1, None), (2, ""), (2, "same id"), (2, "same id"), (None, "no id"), *((10 + k, x) for k, x in enumerate(odd))]
    alphabet = list("aeinrstlou .,'\n\"-09é語😀") + ["  ", " the", "ing", "tion"]
    return out + [(100 + k, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 120)))) for k in range(150)]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_alignment(spark, libraries):
    given = spark.createDataFrame([(d, t, "u", "p", 1) for d, t in rows()], "doc_id long, text string, uid string, pairs string, n long").repartition(3)
    for hot in (alignment.HOT_PAIRS, 3):  # nearly all pairs by the shuffle, too
        got = alignment.alignment(given, A, B, hot=hot)
        same(got.select(*COLS).collect(), [*brute(rows(), *libraries)])
    assert alignment.alignment(given.limit(0), A, B).count() == 0


def test_whole_table(spark, libraries):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op11_alignment(spark, SF).select(*COLS).collect(), [*brute(given, *libraries)])


def test_groups_by_bisection():
    """Groups end where both have an end, also where one token overlaps many."""
    rnd = random.Random(7)
    for _ in range(500):
        n = rnd.randrange(1, 30)
        a, b = ([y - x for x, y in zip(c, c[1:], strict=False)] for c in ([0, *sorted(rnd.sample(range(1, n), rnd.randrange(n))), n] for _ in range(2)))
        ends = {*np.cumsum(a).tolist()} & {*np.cumsum(b).tolist()}
        found = [*zip(*map(np.ndarray.tolist, alignment.groups(np.array(a), np.array(b))), strict=True)]
        assert {sum(a[:j]) for _, j, _, _ in found} == ends == {sum(b[:m]) for *_, m in found}
        assert [i for i, *_ in found] == [0, *(j for _, j, _, _ in found)][:-1] and [k for *_, k, _ in found] == [0, *(m for *_, m in found)][:-1]
    assert all(len(x) == 0 for x in alignment.groups(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_forgetting(libraries, monkeypatch):
    """Tables that are emptied again and again give the same."""
    texts = [t for _, t in rows()]
    whole = alignment.Aligner(A, B).texts(texts)
    monkeypatch.setattr(alignment, "MAX_PARTS", 5)
    small = alignment.Aligner(A, B)
    parts = [small.texts(texts[k : k + 7]) for k in range(0, len(texts), 7)]
    assert [s for p in parts for s in p[1]] == whole[1] and np.array_equal(np.concatenate([p[0] for p in parts]), whole[0])
    assert Counter(np.concatenate([p[2] for p in parts]).tolist()) == Counter(whole[2].tolist())


def test_lots():
    b = pa.RecordBatch.from_pydict({"k": [*range(7)], "text": ["x" * 5, None, "", "y" * 50, "z" * 3, "w" * 3, "v" * 3]})
    got = [x.column(0).to_pylist() for x in lots([b, b.slice(0, 0)], "text", 8)]
    assert got == [[0, 1, 2], [3], [4, 5], [6]]
    assert [x.column(0).to_pylist() for x in lots([b.slice(2)], "text", 8)] == [[2], [3], [4, 5], [6]]
