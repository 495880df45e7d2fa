"""op13 against a plain restatement, on hard cases, many fanouts and partitions, and against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from sensorium.llm import merkle, queries
from sensorium.session import stash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, id string, part int, leaf string"
COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def path(tree, k, fanout):
    for here in tree[:-1]:
        first = k - k % fanout
        yield k - first, [x for j, x in enumerate(here[first : first + fanout], first) if j != k]
        k //= fanout


def brute(rows, fanout=3):
    made = []
    for d, source, lang, n, text in rows:
        changed = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        made.append((source, d, *(h("".join(map(field, (d, source, lang, n, t)))) for t in (text, changed))))
    sources = sorted({x[0] for x in made}, key=lambda s: (s is not None, (s or "").encode()))
    parts = {s: sorted((x for x in made if x[0] == s), key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for s in sources}
    trees = {s: levels([x[2] for x in p], fanout) for s, p in parts.items()}
    top = levels([trees[s][-1][0] for s in sources], fanout)
    for j, s in enumerate(sources):
        for k, (_, d, leaf, changed) in enumerate(parts[s]):
            way = [*path(trees[s], k, fanout), *path(top, j, fanout)]
            now = changed
            for place, others in way:
                now = h("".join([*others[:place], now, *others[place:]]))
            yield d, leaf, trees[s][-1][0], top[-1][0], h("".join(x for _, o in way for x in o)), now, now == top[-1][0]


def rows(seed=1):
    rnd = random.Random(seed)
    out = [(1, None, None, None, None), (1, None, None, None, None), (None, None, "", 0, ""), (None, "a", "x", 1, "\n"), (3, "", "l", 2, "é😀\n日"), (4, "", None, None, "x" * 5000 + "\n" * 50), (5, "alone", "en", 3, "a\nb"), (-7, "z", "e", -1, "-")]
    out += [(k, "hot", "en", k, f"line {k}\nline") for k in range(100, 260)]
    out += [(rnd.randrange(400), rnd.choice(["b", "é", "a b", "hot"]), rnd.choice([None, "de"]), k, rnd.choice([None, "", f"t{k}\n", "same"])) for k in range(60)]
    rnd.shuffle(out)
    return out


def frame(spark, given):
    return spark.createDataFrame([(*x, "k", "i", 1, "f") for x in given], SCHEMA).repartition(3)


def same(df, want):
    assert sorted(map(tuple, df.select(*COLS).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("fanout", [3, 2, 5])
def test_proofs(spark, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "RUN", 17)  # so that partitions begin anywhere
    monkeypatch.setattr(merkle, "STEP", 2)  # and rounds are needed
    same(merkle.proofs(frame(spark, rows()), fanout), [*brute(rows(), fanout)])


def test_few_rows(spark):
    for given in ([], rows()[:1], [(5, "alone", "en", 3, "a\nb"), (6, "alone", "en", 3, None)]):
        same(merkle.proofs(frame(spark, given)), [*brute(given)])


def test_whole_table_and_sql(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = [*brute(given)]
    same(queries.op13_merkle(spark, SF), want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = con.execute(queries.ORACLE_SQL["op13_merkle"])
    assert {c[0] for c in got.description} == {*COLS}
    at = [[c[0] for c in got.description].index(c) for c in COLS]
    assert sorted(tuple(r[k] for k in at) for r in got.fetchall()) == sorted(want)
    assert not all(x[-1] for x in want) and any(x[-1] for x in want)


def test_all_nodes(spark, monkeypatch):
    """The manifest has each node once, from whichever step it came."""
    monkeypatch.setattr(merkle, "RUN", 11)
    monkeypatch.setattr(merkle, "STEP", 1)
    tree = merkle.Tree(stash(merkle.leaves(frame(spark, rows())), "test"))
    got = sorted(tuple(r) for r in tree.nodes().where("key = 'shot'").select("level", "index", "digest").collect())
    own = sorted((x for x in brute_leaves(rows()) if x[0] == "hot"), key=lambda x: x[1:])
    want = [(level, k, x) for level, here in enumerate(levels([x[2] for x in own], 3)) for k, x in enumerate(here)]
    assert got == want
    assert tree.edges.count() < tree.nodes().count()
    with pytest.raises(ValueError):
        merkle.Tree(tree.leaves, 1)


def brute_leaves(given):
    return [(s, d, h("".join(map(field, (d, s, lang, n, t))))) for d, s, lang, n, t in given]


def test_mountains_from_any_index():
    for start in range(10):
        for size in range(1, 30):
            m, tree = merkle.Mountains(3), levels([h(str(k)) for k in range(60)], 3)
            found = [x for k in range(start, start + size) for x in m.add(k, tree[0][k].encode())] + [*m.rest()]
            assert all(tree[level][k].encode() == d for level, k, d, _ in found)
            tops = sorted((k * 3**level, (k + 1) * 3**level) for level, k, _, peak in found if peak)
            assert [a for a, _ in tops] == [start, *(b for _, b in tops)][:-1] and tops[-1][1] == start + size


def test_missing_siblings():
    with pytest.raises(ValueError, match="missing"):
        [*merkle.merge({0: {0: b"a", 2: b"b"}, 1: {}, 2: {}}, 3, 1, 3)]
