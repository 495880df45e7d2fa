"""SimHash near-dedup with exact links: every pair of fingerprints within the radius.

Fingerprints are cut into `BLOCKS` blocks; two within radius r agree on at least BLOCKS - r of them, so equal
values of some BLOCKS - r blocks bring every such pair into one bucket. A bucket is compared bit-sliced: its
fingerprints stand in words of 64 lanes, one word for each bit plane; a query's bit is XORed against the plane and
the result is added to carry-save counters of three bits, 64 distances at a time. Rows of which all lanes are over
the radius are abandoned after every few planes. A bucket of more than TILE fingerprints is split by hash into
tiles, and each pair of tiles is compared by a task of its own, so memory is bounded. From each comparison only a
spanning forest of the links leaves the task, so that a dense group doesn't give all pairs.

Cases: null and empty texts have fingerprint zero and link like any other; a null id is ignored as a smallest id
(a component of null ids only has a null component_id). Copies share a fingerprint and are joined as one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, components, only_rows, row_key, small_batches, stash

SHINGLE, SEED, RADIUS, BLOCKS, TILE = 4, 42, 4, 6, 4096
#: Comparisons of a query with a word of 64 lanes that are made at once.
ROWS_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: __id, __k1, __k2, fp (the fingerprint's 64 bits as a long)."""
    small_batches(docs.sparkSession)
    given = docs.select(docs[id_col].alias("__id"), *row_key(docs[id_col], docs[text_col]), docs[text_col].cast("binary").alias("__text"))
    kind = dict(given.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x, shingle) for x in b.column(3).to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp)], ["__id", "__k1", "__k2", "fp"])

    return given.mapInArrow(run, f"__id {kind}, __k1 long, __k2 long, fp long")


def bucket_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """An array of (which blocks, their bits): equal in at least one for all pairs within the radius."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    masks = [sum(((1 << (b - a)) - 1) << a for a, b in ((cuts[i], cuts[i + 1]) for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    return F.array(*[F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(one(m))).alias("bits")) for k, m in enumerate(masks)])


def over(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter exceeds the radius."""
    out = np.zeros_like(c0)
    for v in range(radius + 1, 8):
        out |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
    return out


def links(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs (i, j), i < j, of one group within the radius. group: sorted; the fingerprints' groups."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    pos = np.arange(n) - np.repeat(first, size)
    lane, starts = (pos % 64).astype(np.uint64), np.flatnonzero(pos % 64 == 0)
    word = np.cumsum(pos % 64 == 0) - 1
    one = np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat(((fp >> np.uint64(p)) & one) << lane, starts) for p in range(64)])
    valid = np.bitwise_or.reduceat(one << lane, starts)
    later = (np.repeat((size + 63) // 64, size) - pos // 64).astype(np.int64)  # words from its own one to its group's last
    ends = np.cumsum(later)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS_AT_ONCE, "right")))
        query = np.repeat(np.arange(at, to), later[at:to])
        w = np.repeat(word[at:to], later[at:to]) + np.arange(len(query)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
        own = w == word[query]
        up_to = (np.uint64(2) << lane[query]) - one  # lane 63: all ones
        lost = ~valid[w] | np.where(own, up_to, np.uint64(0))
        q, c0, c1, c2 = fp[query], *np.zeros((3, len(query)), np.uint64)
        for p in range(64):
            d = planes[p][w] ^ (np.uint64(0) - ((q >> np.uint64(p)) & one))
            carry = c0 & d
            c0 = c0 ^ d
            d = c1 & carry
            c1 = c1 ^ carry
            lost |= c2 & d
            c2 = c2 ^ d
            if p % 8 == 7:
                lost |= over(c0, c1, c2, radius)
                if not (stay := lost != ~np.uint64(0)).all():
                    query, w, q, c0, c1, c2, lost = (x[stay] for x in (query, w, q, c0, c1, c2, lost))
                    if not len(query):
                        break
        if len(query):
            row, bit = np.nonzero(np.unpackbits((~lost).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[row], starts[w[row]] + bit
        at = to


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    parent = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = parent[i], parent[j]
            i, j = i[a != b], j[a != b]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (jump := parent[parent]).tobytes() != parent.tobytes():
                parent = jump
    return parent


def tile_links(buckets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """buckets (k, bits, t1, t2, fp), one task for each (k, bits, t1, t2): edges (a, b) of their spanning forests."""

    def done(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        root = forest(len(fp), links(fp, group, radius))
        member = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[member].view(np.int64)), pa.array(fp[root[member]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((5, 0), np.int64)
        for b in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])], axis=1)
            if rest.shape[1] < ROWS_AT_ONCE:
                continue
            new = np.r_[True, (rest[:4, 1:] != rest[:4, :-1]).any(axis=0)]
            cut = np.flatnonzero(new)[-1]  # the last group may go on
            if cut:
                yield done(rest[4, :cut].copy().view(np.uint64), np.cumsum(new[:cut]))
                rest = rest[:, cut:]
        if rest.shape[1]:
            yield done(rest[4].copy().view(np.uint64), np.cumsum(np.r_[True, (rest[:4, 1:] != rest[:4, :-1]).any(axis=0)]))

    cols = ["k", "bits", "t1", "t2"]
    dealt = buckets.select(*[F.col(c).cast("long").alias(c) for c in (*cols, "fp")]).repartition(*cols).sortWithinPartitions(*cols)
    buckets.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return dealt.mapInArrow(run, "a long, b long")


def near(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that join the fingerprints in classes (fp, one row each) into their components."""
    keyed = classes.select("fp", F.explode(bucket_keys(F.col("fp"), radius, blocks)).alias("x")).select("fp", "x.k", "x.bits")
    counts = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1")
    tiles = keyed.join(counts, ["k", "bits"]).select("k", "bits", "fp", F.ceil(F.col("n") / tile).alias("g"))
    tiles = tiles.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("g")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda u: F.struct(F.least("t", u).alias("t1"), F.greatest("t", u).alias("t2")))
    tiles = tiles.select("k", "bits", "fp", F.explode(pairs).alias("y")).select("k", "bits", "fp", "y.t1", "y.t2")
    return tile_links(tiles, radius)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: __id, __k1, __k2, fp, component_id, first_key (row key of the row that stays)."""
    rows = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__k1"), F.col("__k2"))
    classes = stash(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "classes")
    # components() compares nodes as longs; any total order will do, as component_id comes from the classes' ids.
    roots = components(near(classes.select("fp"), radius))
    whole = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = stash(whole, "rooted")
    best = stash(whole.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("m")), "best")
    named = stash(attach(whole.select("fp", "root", "n"), best, ["root"], "m").select("fp", "best", "n"), "named")
    return attach(rows, named, ["fp"], "n").select("__id", "__k1", "__k2", "fp", F.col("best.id").alias("component_id"), F.col("best").alias("best"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the smallest id; all columns as they were."""
    found = decisions(docs, id_col, text_col)
    kept = found.where((F.col("__k1") == F.col("best.__k1")) & (F.col("__k2") == F.col("best.__k2")))
    return only_rows(docs, kept.select("__k1", "__k2").distinct(), id_col, text_col)
