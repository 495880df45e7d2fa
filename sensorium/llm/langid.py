"""Language identification by cross-parsing.

For each language a suffix automaton holds passages of labelled texts. A text is parsed into phrases, each the longest
match with the labelled text from where the last one ended (a character that isn't in it is a phrase of its own); the
automaton is walked until it has no transition. Phrases times the bits of a place in the labelled text, for each
character, estimate the cross entropy (Ziv and Merhav); the language with the least one wins, of equal ones the first
by name. Letters are lower-cased and all else between them becomes one space. Whole texts are parsed.

Labelled text is a bounded sample: of each language PASSAGES rows at most, drawn by a hash over all rows, with a
passage of LENGTH characters at a drawn place in each; with so many languages that all exceed TOTAL characters, fewer
rows of each. Automata have two states for a character at most.

Cases: null texts and those without a letter are `und` with score 0. Rows without a language or text aren't learned
from; without any, all texts are `und`. A label may be any string. Rows with equal or null ids are predicted each;
other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.session import ship

from .common import lots

#: Rows of a language, characters of a passage, and characters of all languages, at most.
PASSAGES, LENGTH, TOTAL = 50, 300, 1_000_000
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
UNKNOWN = "und"

Node = dict[str, dict]
#: For each language its labelled text.
Sample = dict[str, str]


def letters(text: str | None) -> str:
    """The words in lower case with a space around each; empty without a letter."""
    found = NOT_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    return f" {found} " if any(c.isalpha() for c in found) else ""


def automaton(text: str) -> Node:
    """The start of the suffix automaton of a text: from it each substring, and nothing else, can be walked."""
    start: Node = {}
    nodes, length, link = [start], [0], [-1]
    last = 0
    for c in text:
        now = len(nodes)
        nodes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nodes[p]:
            nodes[p][c] = now
            p = link[p]
        if p >= 0:
            q = nodes[p][c]
            if length[q] > length[p] + 1:
                copy = len(nodes)
                nodes.append(dict(nodes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nodes[p].get(c) == q:
                    nodes[p][c] = copy
                    p = link[p]
                link[q] = q = copy
            link[now] = q
        last = now
    for node in nodes:
        for c, k in node.items():
            node[c] = nodes[k]
    return start


def phrases(start: Node, text: str) -> int:
    """The number of longest matches, one after the other, that a text consists of."""
    n, node = 0, start
    for c in text:
        if c in node:
            node = node[c]
        else:
            if node is not start:
                n += 1
            if c in start:
                node = start[c]
            else:
                n += 1
                node = start
    return n + (node is not start)


class Languages:
    """Automata of a sample, in the order of names."""

    def __init__(self, sample: Sample):
        self.of = {x: (automaton(t), math.log2(len(t))) for x, t in sorted(sample.items())}

    def entropies(self, text: str) -> dict[str, float]:
        """Bits a character in each language, of a text as letters gives it."""
        return {x: phrases(start, text) * bits / len(text) for x, (start, bits) in self.of.items()}

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and its share of the likelihood of a character of all languages."""
        text = letters(text)
        if not text or not self.of:
            return UNKNOWN, 0.0
        found = self.entropies(text)
        best = min(found, key=found.get)
        return best, 1 / sum(2 ** (found[best] - h) for h in found.values())


def sample(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", passages: int = PASSAGES, length: int = LENGTH, total: int = TOTAL) -> Sample:
    """Passages of labelled rows; learn tells which rows may be learned from."""
    text = docs[text_col]
    drawn = F.xxhash64(docs[id_col], text)
    rows = docs.where(learn & docs[lang_col].isNotNull() & text.rlike(r"\p{L}")).select(docs[lang_col].cast("string").alias("lang"), text.alias("text"), drawn.alias("drawn"))
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    each = min(passages, max(1, total // (length * max(1, len(sizes)))))
    # twice as many rows as are wanted, so that enough are drawn; then the ones with the least hashes
    share = F.shiftrightunsigned("drawn", 11) / float(1 << 53)
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame(sizes, "lang string, n long")), "lang").where(share * F.col("n") < 2 * each + 20)
    place = F.pmod(F.xxhash64("drawn"), F.greatest(F.lit(1), F.length("text") - length + 1)).cast("int") + 1
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.select("lang", "drawn", F.substr("text", place, F.lit(length)).alias("text")).collect()):
        own = out.setdefault(r.lang, [])
        if len(own) < each and (found := letters(r.text)):
            own.append(found)
    return {x: "\n".join(t) for x, t in out.items() if t}


_models: dict[int, tuple[Sample, Languages]] = {}


def languages(sample: Sample) -> Languages:
    """A worker's automata of a sample; one is kept."""
    key = hash(tuple(sorted(sample.items())))
    if key not in _models or _models[key][0] != sample:
        _models.clear()
        _models[key] = sample, Languages(sample)
    return _models[key][1]


def predictions(docs: DataFrame, sample: Sample, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sent = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = languages(sent.value)
        for b in lots(batches, "text"):
            made = [model.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    return given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, lang_pred string, score double")
