"""Toxicity: a logistic classifier that is regularised by counterfactuals.

Features are whole words and word beginnings, each at three levels: in the text at all, twice or more, in at least
one of 200 words. Those kept are the MAX_FEATURES that tell toxic from other labelled texts best, either way. For each
labelled text with identity terms there are counterfactual ones, with each term swapped for the others of its group.
Training adds to the logistic loss lam times the mean squared difference of a text's and its counterfactuals' scores
(as log odds), so a mere mention of a group cannot carry the score, however the labels are spread over groups.

Training uses at most MAX_TRAIN labelled rows (those whose ids hash lowest), a fixed bound: the model is as small at
every size of the corpus. Features are counted and chosen on Spark; only the chosen features' places of these rows
come to the driver. Every row is then scored by its text alone.

Cases: null and empty texts get the score of a text without features. Rows with a null label or id aren't learned
from; an id labelled more than once counts as toxic if half of its labels do. Without labels of both kinds, all
scores are the share of toxic labels (0 without labels). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, fresh, row_key, small_batches, stash

MAX_TRAIN, MAX_FEATURES, LEAST_DOCS, LEAST_GAIN = 20_000, 4_000, 3, 20.0
PREFIXES, THRESHOLD, DENSE = (3, 4, 5, 6), 0.3, 200
#: Words remembered by a worker, of so many bytes at most, and features that a task counts before it passes them on.
MAX_WORDS_KNOWN, MAX_BYTES, MAX_COUNTED = 300_000, 64, 1_000_000

#: Identity terms by group, each to be swapped for the next one of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("black", "white", "asian", "latino"), ("blacks", "whites", "asians", "latinos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrant", "native"), ("immigrants", "natives"),
    ("disabled", "abled"), ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"), ("elderly", "youthful"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"), ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
)
GROUP_OF = {a.encode(): [x.encode() for x in group] for group in IDENTITY for a in group}


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


def forms(word: bytes) -> list[str]:
    """The whole word, and its beginnings."""
    w = word.decode("utf-8", "replace")
    return [f"{w}$", *(w[:k] for k in PREFIXES if len(w) > k)]


class Forms(dict):
    """Of a word, those of its forms that the model knows; bounded."""

    def __init__(self, known):
        self.known = known

    def __missing__(self, word: bytes) -> tuple:
        found = tuple([self.known[f] for f in forms(word) if f in self.known])
        if len(word) <= MAX_BYTES:
            if len(self) >= MAX_WORDS_KNOWN:
                self.clear()
            self[word] = found
        return found


def levels(counts: Counter, n_words: int) -> list[tuple]:
    """Features of a text: (form, level)."""
    out = []
    for f, n in counts.items():
        out.append((f, 0))
        if n >= 2:
            out.append((f, 1))
        if n * DENSE >= n_words:
            out.append((f, 2))
    return out


def features(w: list[bytes], table: Forms) -> list[tuple]:
    return levels(Counter([f for found in map(table.__getitem__, w) if found for f in found]), len(w))


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, id_col: str, text_col: str, most: int = MAX_TRAIN) -> DataFrame:
    """At most `most` labelled rows: text (bytes), y. Of rows with one id, the one with the least hash of its text."""
    y = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & use).groupBy(labels["doc_id"].alias("__lid")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    few = y.orderBy(F.xxhash64("__lid"), "__lid").limit(most)  # `most` rows, so small enough to send to all tasks
    found = docs.join(F.broadcast(few), docs[id_col] == F.col("__lid")).select("__lid", "y", docs[text_col].cast("binary").alias("text"))
    return found.groupBy("__lid", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")


def choose(rows: DataFrame, most: int = MAX_FEATURES) -> list[tuple]:
    """The (form, level) that tell toxic rows from others best (chi-square), whichever of both they speak for; `most` at
    most, which is a parameter of the classifier. Forms are counted on Spark, those of rare occurrence first left out."""
    n1, n0 = (rows.where(F.col("y") == y).count() for y in (1, 0))
    if not n1 or not n0:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def held() -> pa.RecordBatch:
            every = list({*found[0], *found[1]})
            columns = [pa.array([f for f, _ in every], pa.string()), pa.array([k for _, k in every], pa.int32()), *[pa.array([found[y][x] for x in every], pa.int64()) for y in (0, 1)]]
            return pa.RecordBatch.from_arrays(columns, ["f", "level", "a0", "a1"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                found[y].update(levels(Counter([f for x in w for f in forms(x)]), len(w)))
                if len(found[0]) + len(found[1]) > MAX_COUNTED:
                    yield held()
                    found[0].clear()
                    found[1].clear()
        yield held()

    counted = rows.mapInArrow(count, "f string, level int, a0 long, a1 long").groupBy("f", "level").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))
    n, have = float(n1 + n0), (F.col("a0") + F.col("a1")).cast("double")
    over = F.col("a1") - have * n1 / n
    gain = over * over * n**3 / (have * (n - have) * float(n1) * float(n0))
    good = counted.where((have >= LEAST_DOCS) & (have < n)).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    return [(r.f, r.level) for r in good.orderBy(F.desc("gain"), "f", "level").limit(most).collect()]


def swaps(w: list[bytes]) -> list[list[bytes]]:
    """The counterfactuals of a text's words: each identity term swapped for the next of its group, then for the one
    after that, and so on through the largest group that the text has."""
    most = max((len(GROUP_OF[x]) for x in w if x in GROUP_OF), default=1)
    return [[GROUP_OF[x][(GROUP_OF[x].index(x) + k) % len(GROUP_OF[x])] if x in GROUP_OF else x for x in w] for k in range(1, most)]


def examples(rows: DataFrame, chosen: list[tuple]) -> list[tuple[int, list[int], list[list[int]]]]:
    """Of each training row: y, the places of its chosen features, and of those of its counterfactuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: k for k, f in enumerate(chosen)}
        table = Forms({f: f for f, _ in chosen})
        show = lambda w: [place[f] for f in features(w, table) if f in place]
        for b in batches:
            split = [words(text) for text in b.column(0).to_pylist()]
            own, swapped = [show(w) for w in split], [[show(x) for x in swaps(w)] for w in split]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))], ["y", "own", "swapped"])

    return [tuple(r) for r in rows.mapInArrow(run, "y int, own array<int>, swapped array<array<int>>").toLocalIterator()]


def fit(data: list[tuple[int, list[int], list[list[int]]]], n_features: int, lam: float = 1.0, l2: float = 3e-3, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias; the regularised loss is minimised by Adam."""
    y = np.array([d[0] for d in data], float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return np.zeros(n_features), math.log(share / (1 - share))

    def matrix(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.array([f for x in sets for f in x], np.int64)

    row, col = matrix([d[1] for d in data])
    twin = [(d[1], x, 1 / len(d[2])) for d in data for x in d[2]]
    (r1, c1), (r2, c2) = matrix([d[0] for d in twin]), matrix([d[1] for d in twin])
    share = np.array([d[2] for d in twin])
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = math.log(y.sum() / (len(y) - y.sum()))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(y)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.r_[np.bincount(col, g[row], n_features), g.sum()]
        grad[:-1] += l2 * w[:-1] / 10
        if twin:
            d = (np.bincount(r1, w[c1], len(twin)) - np.bincount(r2, w[c2], len(twin))) * share * 2 * lam / len(y)
            grad[:-1] += np.bincount(c1, d[r1], n_features) - np.bincount(c2, d[r2], n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN, lam: float = 1.0, features: int = MAX_FEATURES) -> tuple[dict[tuple, float], float]:
    """The model: weights of (form, level), and bias. use: which rows of labels may be learned from."""
    small_batches(docs.sparkSession)
    rows = stash(training_rows(docs, labels, F.lit(True) if use is None else use, id_col, text_col, most), "labelled")
    chosen = choose(rows, features)
    weights, bias = fit(examples(rows, chosen), len(chosen), lam)
    return {f: float(x) for f, x in zip(chosen, weights, strict=True) if abs(x) > 1e-6}, bias


def score(text: bytes | None, table: Forms, bias: float) -> float:
    """table: gives of a word the forms' weights by level, and the form."""
    w = words(text)
    counts = Counter([f for found in map(table.__getitem__, w) if found for f in found])
    z, n = bias, len(w)
    for (_, one, two, dense), k in counts.items():
        z += one + (two if k >= 2 else 0.0) + (dense if k * DENSE >= n else 0.0)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def scored(docs: DataFrame, model: tuple[dict[tuple, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, text hash keys, score."""
    small_batches(docs.sparkSession)
    weights, bias = model
    known = {f: (f, *(weights.get((f, k), 0.0) for k in range(3))) for f, _ in weights}
    given = docs.select(docs[id_col].alias("doc_id"), *row_key(docs[id_col], docs[text_col]), docs[text_col].cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Forms(known)
        for b in batches:
            got = [score(x, table, bias) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.float64())], ["doc_id", "__k1", "__k2", "score"])

    return given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, __k1 long, __k2 long, score double")


def drop_toxic(docs: DataFrame, model: tuple[dict[tuple, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those scored THRESHOLD or more, all columns as they were."""
    small_batches(docs.sparkSession)
    weights, bias = model
    known = {f: (f, *(weights.get((f, k), 0.0) for k in range(3))) for f, _ in weights}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Forms(known)
        for b in batches:
            kept = pa.array([score(x, table, bias) < THRESHOLD for x in b.column(b.num_columns - 1).to_pylist()], pa.bool_())
            yield b.select(range(b.num_columns - 1)).filter(kept)

    (name,) = fresh(docs, "__text")
    return docs.withColumn(name, docs[text_col].cast("binary")).mapInArrow(run, docs.schema)
