"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts, one scan of the corpus.

Benchmark texts are normalised (A-Z lower-cased; words are runs of letters, digits and non-ASCII characters). A window
is 13 consecutive words of a text; a shorter text is one window. Any window holds one of the chunks of seven words into
which its text is cut, so these chunks (and the short texts) are the patterns of an automaton over word numbers, which
has no more states than the benchmark has words. Where a chunk occurs in a document, its six words before and after are
compared, which any window with it lies within: if 13 or more agree, they are hit. Places of a chunk that have the same
six words on both sides are compared once, so that texts of repeated words take no longer. Word places are mapped back
to offsets in the original text where spans are asked for.

The pieces are a table in the shared folder, which workers read; a worker holds one automaton. Benchmarks of more than MAX_WORDS words are dealt by hash into lots, each with an
automaton of its own; the corpus is still read once: each group of a partition's rows (GROUP bytes of text) meets one
automaton after the other. Long texts of a benchmark are cut into pieces that overlap by a window less one word.

Cases: null texts have no words and no hits; an item without words has no window; items with the same window are all
reported; a null item id isn't reported, but its words are hit. Repeated rows each get their result. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.sources.heads import store

from .common import WORD_TABLE, fresh, row_key, small_batches, stash

WINDOW, MAX_WORDS, PIECE, GROUP = 13, 2_000_000, 4096, 1 << 25
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


class Patterns:
    """The automaton over the chunks of pieces, as numbers of words. A chunk has the words before and after it that a
    window may hold besides it, and the items of each such context; places with the same context are one."""

    def __init__(self, pieces: list[tuple[bytes, list[str]]], size: int = WINDOW):
        self.size, self.chunk = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        held: dict[tuple, dict[tuple[tuple, tuple], set[str]]] = {}
        for text, ids in pieces:
            p = tuple([self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split(b" ")])
            step = self.chunk if len(p) >= size else len(p)
            reach = size - self.chunk if len(p) >= size else 0
            for o in range(0, len(p) - step + 1, step):
                context = p[max(0, o - reach) : o][::-1], p[o + step : o + step + reach]
                held.setdefault(p[o : o + step], {}).setdefault(context, set()).update(ids)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, contexts in held.items():
            self.automaton.add_word(key, (len(key), [(*c, ids) for c, ids in contexts.items()]))
        self.empty = not held
        if held:
            self.automaton.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges (first, end) of hit words, ids of items with an occurring window."""
        get = self.numbers.get
        d = tuple([get(x, 0) for x in w])
        if not d or self.empty:
            return [], set()
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        for last, (n, contexts) in self.automaton.iter(d):
            at, end = last - n + 1, last + 1
            for before, after, ids in contexts:
                a, b = at, end
                if n >= self.chunk and (before or after):
                    for x in before:
                        if not a or d[a - 1] != x:
                            break
                        a -= 1
                    for x in after:
                        if b == len(d) or d[b] != x:
                            break
                        b += 1
                    if b - a < self.size:
                        continue
                ranges.append((a, b))
                found |= ids
        return merged(ranges), found


_built: dict[str, Patterns] = {}


def patterns(lot: str, size: int) -> Patterns:
    """The automaton of a lot, the place of its pieces in the shared folder; a worker keeps the last one."""
    if lot not in _built:
        _built.clear()
        _built[lot] = Patterns(pieces_of(lot), size)
    return _built[lot]


def pieces_of(lot: str) -> list[tuple[bytes, list[str]]]:
    """The pieces of a lot with the ids of their items, read from the shared folder file by file; none if there is no such lot."""
    where, path, _ = store(lot)
    out = []
    for info in where.get_file_info(FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                found = pq.ParquetFile(f).read(columns=["piece", "items"], use_threads=False)
            out += zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as ranges of characters of the original text."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def lots(benchmark: DataFrame, item_col: str, item_text: str, size: int, most: int) -> list[str]:
    """The benchmark's different pieces with the ids of their items, written in lots of about `most` words: their places.

    Workers read them there, so nothing of the benchmark passes through the driver, and lost executors lose nothing."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text].cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                for k in range(0, max(1, len(w) - size + 1) if w else 0, PIECE):
                    part = w[k : k + PIECE + size - 1]
                    out.append((item, b" ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["item", "piece", "n"])

    pieces = items.mapInArrow(cut, "item string, piece binary, n long").groupBy("piece", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    pieces = stash(pieces, "benchmark-pieces")
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // most) or 1
    if n == 1:
        return [pieces._stashed]
    dealt = stash(pieces.withColumn("lot", F.pmod(F.xxhash64("piece"), F.lit(n)).cast("int")).repartition("lot"), "benchmark-lots", "lot")
    return [f"{dealt._stashed}/lot={k}" for k in range(n)]


def scanned(batches: Iterator[pa.RecordBatch], sent: list[str], size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list, set]]]]:
    """Batches, the text in their last column, each with (number of words, ranges, items) of its rows."""

    def done(group: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        out = [[(0, [], set())] * b.num_rows for b in group]
        for lot in sent:
            p = patterns(lot, size)
            for b, rows in zip(group, out, strict=True):
                text = b.column(b.num_columns - 1)
                for k in range(b.num_rows):
                    w = words(text[k].as_py())
                    ranges, items = p.scan(w)
                    rows[k] = len(w), merged(rows[k][1] + ranges) if rows[k][1] else ranges, rows[k][2] | items
        yield from zip(group, out, strict=True)

    group, held = [], 0
    for b in batches:
        group.append(b)
        held += b.nbytes
        if held >= GROUP or len(sent) == 1:
            yield from done(group)
            group, held = [], 0
    yield from done(group)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """A row for each row of docs: __id, __k1, __k2, n_words, n_hit, ranges (of words), items (ids as strings)."""
    small_batches(docs.sparkSession)
    given = docs.select(docs[id_col].alias("__id"), *row_key(docs[id_col], docs[text_col]), docs[text_col].cast("binary").alias("__text"))
    sent = lots(benchmark, item_col, item_text, WINDOW, max_words)
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in scanned(batches, sent, WINDOW):
            n_hit = [sum(y - x for x, y in r) for _, r, _ in rows]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([[{"a": x, "b": y} for x, y in r[1]] for r in rows], span), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["__id", "__k1", "__k2", "n_words", "n_hit", "ranges", "items"])

    return given.mapInArrow(run, f"__id {dict(given.dtypes)['__id']}, __k1 long, __k2 long, n_words long, n_hit long, ranges array<struct<a:long,b:long>>, items array<string>")


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of documents with hits: doc_id, and spans, the hit passages as ranges of characters of the original text."""
    found = hits(docs, benchmark, id_col, text_col).where("n_hit > 0").select("__k1", "__k2", "ranges").dropDuplicates(["__k1", "__k2"])
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *row_key(docs[id_col], docs[text_col]))
    both = given.join(found, ["__k1", "__k2"]).select("doc_id", "text", "ranges")

    def run(frames):
        for f in frames:
            f["spans"] = [[{"a": a, "b": b} for a, b in original_spans(t, [(r["a"], r["b"]) for r in x])] for t, x in zip(f["text"], f["ranges"], strict=True)]
            yield f[["doc_id", "spans"]]

    return both.mapInPandas(run, f"doc_id {dict(given.dtypes)['doc_id']}, spans array<struct<a:long,b:long>>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """docs without the contaminated ones, all columns as they were: decided within the scan, without a shuffle."""
    small_batches(docs.sparkSession)
    sent = lots(benchmark, "item_id", "text", WINDOW, max_words)
    (name,) = fresh(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in scanned(batches, sent, WINDOW):
            n_hit = [sum(y - x for x, y in r) for _, r, _ in rows]
            clean = pa.array([not (h and 20 * h >= n) for h, (n, _, _) in zip(n_hit, rows, strict=True)])
            yield b.select(range(b.num_columns - 1)).filter(clean)

    return docs.withColumn(name, docs[text_col].cast("binary")).mapInArrow(run, docs.schema)
