"""Alignment of two tokenizers' tokens: byte-level merges (A) and SentencePiece merges (B).

Both are put on the bytes of a space and the text. B's tokens are a static interval index, sorted starts and ends; for
each A token two bisections list the B tokens that it overlaps. A gap between A tokens that no B token spans is a
group's end; within a group all A and B tokens are linked. Spaces between two other characters always are such gaps,
for both tokenizers, so texts are cut there and each part (a word with its space) is aligned once and remembered.

A pair of ids counts the documents in which it is linked. Documents keep their distinct pairs with the links of each;
these are exploded, counted, and joined with the counts again by `attach`: a bounded number of frequent pairs by
broadcast, the rest, of which none is hot, by a shuffle. Sums are taken by document.

Cases: null and empty texts, and those whose joined tokens differ from the space and the text (such as with U+2581 in
them), have no tokens: zeros, and an empty groups_sha256. Rows with equal or null ids are documents of their own.
Strings of special tokens are plain text. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.session import ship, stash

from .common import attach, lots
from .pieces import SPACE, Pieces

#: Parts that a worker remembers, and characters in them; with more, those met once are forgotten before the next lot.
MAX_PARTS, MAX_CHARS = 240_000, 1 << 23
#: Pairs that are broadcast with their counts, at most.
HOT_PAIRS = 1 << 18
SPACES, CUT = regex.compile(r"\s\s"), regex.compile(r"(?<=\S) (?=\S)")

#: Places in a part where both tokenizers may be certain to cut.
MARKS = ".,;:!?"
INNER = regex.compile(rf"(?<=\p{{L}})(?=[{MARKS}])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First A, past A, first B and past B of each group; a and b are the tokens' lengths in bytes, with equal sums.

    Each A token's overlaps are found in the index of B by bisection (of all A tokens at once); a group ends at a gap
    of A tokens that no B token spans.
    """
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    low, past = np.searchsorted(b_ends, a_ends - a, "right"), np.searchsorted(b_ends - b, a_ends, "left")
    ends = np.flatnonzero(np.append(past[:-1] <= low[1:], [True] * bool(len(a)))) + 1
    first = np.append(0, ends)[:-1].astype(np.int64)
    return first, ends, low[first], past[ends - 1]


def run_lengths(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, as many as its size says, of each."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of x, whose sizes (also zero) are given."""
    whole, ends = np.append(0, np.cumsum(x)), np.cumsum(sizes)
    return whole[ends] - whole[ends - sizes]


class Aligner:
    """Two tokenizers, and the parts that have been aligned, numbered in the order in which they came."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        at = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for x, k in vocabulary.items():
            self.a_size[k] = len(x) if all(c in at for c in x) else len(x.encode())
        b = self.b
        pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
        self.b_size = np.array([1 if b.is_byte(k) else len(p.replace(SPACE, " ").encode()) for k, p in enumerate(pieces)])
        self.digits = np.array([str(k) for k in range(max(len(self.a_size), len(self.b_size)))], object)
        #: Characters that stand together in a piece; between others B always cuts.
        self.together = {x + y for k, p in enumerate(pieces) if not (b.is_byte(k) or b.is_control(k) or b.is_unknown(k)) for x, y in pairwise(p)}
        #: No piece goes over a line's end, so what stands after one is encoded as it is elsewhere.
        self.lines = not any("\n" in p for p in pieces)
        self.line = len(b.encode("\n"))
        self.clear()

    def clear(self) -> None:
        """Empty tables."""
        self.known: dict[str, int] = {}  # parts after a space that aren't cut any more
        self.bare: dict[str, int] = {}  # parts of parts that are, without a space
        self.said: list[str | None] = []
        self.bad: list[int] = []  # parts without tokens
        self.held = 0  # characters of parts
        self.numbers = array("q")  # n_a, n_b, n_groups, n_links
        self.pairs, self.times, self.starts = array("q"), array("q"), array("q", [0])
        self.used = np.zeros(0, np.int64)  # how often each part was met, halved whenever parts are forgotten

    def forget(self) -> None:
        """Keeps the parts that were met more than once, and of these not more than fill half of the tables."""
        least = max(1, int(np.partition(self.used, -MAX_PARTS // 2)[-MAX_PARTS // 2]) if len(self.used) >= MAX_PARTS // 2 else 1)
        keep = self.used > least
        at = np.flatnonzero(keep)
        now = np.cumsum(keep) - 1
        known, bare, said = self.known, self.bare, self.said
        starts = np.frombuffer(self.starts, np.int64)
        sizes = (starts[1:] - starts[:-1])[at]
        held = run_lengths(starts[at], sizes)
        numbers, pairs, times = np.frombuffer(self.numbers, np.int64).reshape(-1, 4)[at], np.frombuffer(self.pairs, np.int64)[held], np.frombuffer(self.times, np.int64)[held]
        used = self.used[at] // 2
        self.clear()
        self.known, self.bare = ({x: int(now[k]) for x, k in old.items() if keep[k]} for old in (known, bare))
        self.held = sum(map(len, self.known)) + sum(map(len, self.bare))
        if self.held > MAX_CHARS // 2:
            return self.clear()
        self.said, self.used = [said[k] for k in at], used
        self.bad = [k for k, x in enumerate(self.said) if x is None]
        for into, x in ((self.numbers, numbers), (self.pairs, pairs), (self.times, times), (self.starts, np.cumsum(sizes))):
            into.frombytes(np.ascontiguousarray(x, np.int64).tobytes())
        return None

    def align(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> range:
        """Keeps each part's groups as a string (None if its tokens aren't its bytes), its numbers, and the links of each pair."""
        of_lists = lambda x: (np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(chain.from_iterable(x), np.int64))
        (n_a, a), (n_b, b) = of_lists(a), of_lists(b)
        n = np.fromiter((len(x.encode()) for x in parts), np.int64, len(parts))
        good = (sums(self.a_size[a], n_a) == n) & (sums(self.b_size[b], n_b) == n)  # what A lacks is left out, what B lacks is longer
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        # the parts lie one after another on one axis of bytes: where one ends, tokens of both do
        first_a, past_a, first_b, past_b = groups(self.a_size[a], self.b_size[b])
        in_a, in_b = past_a - first_a, past_b - first_b
        part = np.repeat(np.arange(len(parts)), n_a)[first_a]
        n_groups = np.bincount(part, minlength=len(parts))
        numbers = np.stack([n_a, n_b, n_groups, sums(in_a * in_b, n_groups)], axis=1)
        # different ids of each group with their counts, then all pairs of them
        ids = lambda x, sizes, most: np.unique(np.repeat(np.arange(len(part)), sizes) * most + x, return_counts=True)
        (x, of_x), (y, of_y) = ids(a, in_a, len(self.a_size)), ids(b, in_b, len(self.b_size))
        (group, x), (other, y) = np.divmod(x, len(self.a_size)), np.divmod(y, len(self.b_size))
        own = np.bincount(other, minlength=len(part))
        held = own[group]
        at = run_lengths((np.cumsum(own) - own)[group], held)
        self.pairs.frombytes((np.repeat(x, held) * len(self.b_size) + y[at]).tobytes())
        self.times.frombytes((np.repeat(of_x, held) * of_y[at]).tobytes())
        stops = np.cumsum(np.bincount(part[group], held, len(parts)).astype(np.int64)) + self.starts[-1]
        # a1,a2|b1;a3|b2,b3 of all parts at once, a line for each
        said = np.full(2 * (len(a) + len(b)), ",", object)
        said[2 * (np.arange(len(a)) + np.repeat(first_b, in_a))] = self.digits[a]
        said[2 * (np.arange(len(b)) + np.repeat(past_a, in_b))] = self.digits[b]
        said[2 * (past_a + first_b) - 1] = "|"
        said[2 * (past_a + past_b) - 1] = ";"
        said[2 * np.cumsum(n_a + n_b)[good] - 1] = "\n"
        lines = iter("".join(said.tolist()).split("\n"))
        first = len(self.said)
        self.said += [next(lines) if x else None for x in good.tolist()]
        self.bad += (np.flatnonzero(~good) + first).tolist()
        self.numbers.frombytes(numbers.tobytes())
        self.starts.frombytes(stops.tobytes())
        self.held += int(n.sum())
        return range(first, len(self.said))

    def cut(self, part: str) -> list[str]:
        """A part, cut where both tokenizers do whatever stands around: beside line ends, and between a letter and a mark."""
        if part.isalpha() or " " in part or not self.lines:
            return [part]
        if part[:-1].isalpha() and part[-1] in MARKS:
            return [part[:-1], part[-1]] if part[-2:] not in self.together else [part]
        at = [k for m in INNER.finditer(part) if part[(k := m.start()) - 1 : k + 1] not in self.together]
        return [part[i:j] for i, j in pairwise([0, *at, len(part)])]

    def learn(self, parts: set[str]) -> dict[str, list[int]]:
        """Aligns what isn't known; gives the parts that consist of others, which aren't remembered, and of which ones."""
        known, bare = self.known, self.bare
        cut = {x: self.cut(x) for x in parts if x not in known}
        first = [x for x in {p[0] for p in cut.values()} if x not in known]
        a = self.a.encode_batch_fast([" " + x for x in first], add_special_tokens=False)
        known.update(zip(first, self.align([" " + x for x in first], [e.ids for e in a], self.b.encode(first, num_threads=1)), strict=True))
        later = [x for x in {x for p in cut.values() if len(p) > 1 for x in p[1:]} if x not in bare]
        a = self.a.encode_batch_fast(later, add_special_tokens=False)
        b = [ids[self.line :] for ids in self.b.encode(["\n" + x for x in later], num_threads=1)]
        bare.update(zip(later, self.align(later, [e.ids for e in a], b), strict=True))
        return {x: [known[own], *[bare[y] for y in rest]] for x, (own, *rest) in cut.items() if rest}

    def places(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the parts that lists of parts consist of, and how many each list has; none if one has no tokens."""
        joined = self.learn(set().union(*cut))
        known, n = self.known, len(self.said)
        known.update((x, n + k) for k, x in enumerate(joined))  # while the lists are looked up
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, lengths.sum())
        for x in joined:
            del known[x]
        several = ids >= n
        wide = np.ones(len(ids), np.int64)
        members = np.fromiter(map(len, joined.values()), np.int64, len(joined))
        wide[several] = members[ids[several] - n]
        words = np.repeat(ids, wide)
        words[np.repeat(several, wide)] = np.fromiter(chain.from_iterable(joined.values()), np.int64)[run_lengths((np.cumsum(members) - members)[ids[several] - n], wide[several])]
        sizes = sums(wide, lengths)
        if self.bad:
            lost = sums(np.isin(words, self.bad), sizes) > 0
            words, sizes = words[~np.repeat(lost, sizes)], np.where(lost, 0, sizes)
        return words, sizes

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links and groups_sha256; the pairs and links of all, and where each text's end."""
        cut = [[] if not t or SPACE in t else t.split(" ") if not SPACES.search(t) and not t[0].isspace() and not t[-1].isspace() else CUT.split(t) for t in texts]
        if len(self.known) > MAX_PARTS or self.held > MAX_CHARS:
            self.forget()
        words, sizes = self.places(cut)
        said, ends = self.said, np.cumsum(sizes)
        shas = [hashlib.sha256(";".join(map(said.__getitem__, words[b - n : b].tolist())).encode()).hexdigest() if n else "" for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        doc = np.repeat(np.arange(len(texts)), sizes)
        numbers = np.stack([sums(x, sizes) for x in np.frombuffer(self.numbers, np.int64).reshape(-1, 4)[words].T], axis=1)
        # (text, part) with its count, then (text, pair) with its links
        some, n = np.unique(doc * max(1, len(said)) + words, return_counts=True)
        doc, words = np.divmod(some, max(1, len(said)))
        self.used = np.append(self.used, np.zeros(len(said) - len(self.used), np.int64)) + np.bincount(words, n, len(said)).astype(np.int64)
        starts, stops = (np.frombuffer(self.starts, np.int64)[words + k] for k in (0, 1))
        held = stops - starts
        at = run_lengths(starts, held)
        own, pair = np.unique(np.frombuffer(self.pairs, np.int64)[at], return_inverse=True)
        times = np.frombuffer(self.times, np.int64)[at] * np.repeat(n, held)
        key = np.repeat(doc, held) * max(1, len(own)) + pair
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        links = np.add.reduceat(times[order], first) if len(first) else times
        doc, pair = np.divmod(key[first], max(1, len(own)))
        return numbers, shas, own[pair], links, np.searchsorted(doc, np.arange(len(texts)), "right")


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid (a row's number), n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * pieces of B + B id), times."""
    ship(docs.sparkSession)
    given = docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("uid"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for b in lots(batches, "text", 1 << 20):
            n, said, pairs, times, ends = both.texts(b.column(2).to_pylist())
            ends = pa.array(np.append(0, ends), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(n[:, k]) for k in range(4)), pa.array(said, pa.string()), *lists], names)

    schema = f"doc_id {dict(given.dtypes)['doc_id']}, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    return given.mapInArrow(run, schema)


def pair_counts(links: DataFrame, size: int) -> DataFrame:
    """pair, n (documents that hold it) and best (no pair of its A id is in more); links has a row for a document's pair."""
    counts = stash(links.groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / size).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary at most
    joined = counts.select("*", a).join(F.broadcast(most), "a", "inner")
    return stash(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    size = len(Pieces(b_path).pieces)  # raises ValueError for models that don't cut at spaces
    rows = stash(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = pair_counts(rows.select(F.explode("pairs").alias("pair")), size)
    links = rows.select("uid", F.explode(F.map_from_arrays("pairs", "times")).alias("pair", "times"))
    sums = attach(links, counts, ["pair"], "n", hot).groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
