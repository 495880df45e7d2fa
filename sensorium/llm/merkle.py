"""A Merkle manifest of a dataset: a tree of each source's rows, a tree of the sources' roots, and proofs.

Leaves are sorted by (source, id, leaf) into range partitions. Rows of one source in one partition are a run; runs are
numbered by the counts of those before, so each leaf has its index in its source. A task goes over its runs with a
mountain-range stack: a node that ends a run of `fanout` siblings carries, like a digit, into a node of the next level.
Nodes whose siblings lie in other partitions remain as peaks, a few for each level. Peaks are merged in rounds: those
under one node `STEP` levels higher are a group (of fanout ** STEP nodes at most), in which the last siblings of a
level may be fewer: short runs are hashed as they are, without padding. The number of leaves tells which runs are short.

For proofs, each run gets its frame: of each level the nodes around its first and last leaf, which are peaks or came
from merging. With its own leaves they give all siblings of all its leaves, so no row carries a path through a shuffle.
The sources' roots are the leaves of one more tree of the same kind.

Cases: a null is hashed as `-`, so it differs from an empty value; null sources and null ids come first; rows with
equal source and id are ordered by leaf, and identical rows are leaves of their own. Other columns don't matter,
whatever their names. A lone leaf is its source's root, a lone source's root the root, and a proof without siblings is
the hash of nothing. An empty table gives no rows (and no nodes).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.session import ship, stash

FANOUT = 3
#: Levels that a round of merging goes up, and leaves that a range partition has on average at most.
STEP, RUN = 8, 100_000


def combine(parts: Iterable[bytes]) -> bytes:
    """The hash of digests, as hexadecimal text like these."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(*fields: Column) -> Column:
    """A row's digest in hexadecimal: each field with its length in bytes, nulls as `-`."""
    said = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def width(n: int, level: int, fanout: int) -> int:
    """Nodes on a level over n leaves."""
    return -(-n // fanout**level)


def depth(n: int, fanout: int) -> int:
    return next(k for k in range(99) if width(n, k, fanout) <= 1)


class Mountains:
    """The peaks of leaves that come one after another, from any index on."""

    def __init__(self, fanout: int):
        self.fanout, self.open = fanout, defaultdict(list)

    def add(self, index: int, digest: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
        """Takes the next leaf; gives (level, index, digest, whether it is a peak) of nodes that are now settled."""
        level = 0
        while True:
            run = self.open[level]
            run.append((index, digest))
            if (index + 1) % self.fanout:
                return
            whole = len(run) == self.fanout  # else its first siblings are elsewhere
            for k, d in run:
                yield level, k, d, not whole
            digest = combine(d for _, d in run)
            run.clear()
            if not whole:
                return
            index //= self.fanout
            level += 1

    def rest(self) -> Iterator[tuple[int, int, bytes, bool]]:
        for level, run in self.open.items():
            for k, d in run:
                yield level, k, d, True
        self.open.clear()


def merge(found: dict[int, dict[int, bytes]], n: int, top: int, fanout: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, digest) of the nodes, up to level `top`, over nodes (by level and index) of which no sibling lacks."""
    for level in range(min(top, depth(n, fanout))):
        runs = defaultdict(list)
        for k in sorted(found[level]):
            runs[k // fanout].append(found[level][k])
        for k, run in runs.items():
            if len(run) != min(fanout, width(n, level, fanout) - k * fanout):
                raise ValueError(f"siblings of node {k} on level {level + 1} are missing")
            found[level + 1][k] = digest = combine(run)
            yield level + 1, k, digest


def ordered(rows: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """rows (key, id, leaf, ...) with `part` and `index`, sorted; and runs: part, key, start, size, n (leaves of the key)."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RUN + 1)
    keys = ["key", "id", "leaf", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("tie")
    dealt = dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    dealt = stash(dealt, "merkle-leaves")
    runs = dealt.groupBy("part", "key").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    own = Window.partitionBy("key")
    before = F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stash(runs.select("*", F.coalesce(before, F.lit(0)).alias("start"), F.sum("size").over(own).alias("n")), "merkle-runs")
    index = F.col("at") - F.col("first") + F.col("start")
    return dealt.join(runs.select("part", "key", "first", "start"), ["part", "key"]).withColumn("index", index).drop("at", "first", "start"), runs.drop("first")


def peaks(leaves: DataFrame, fanout: int) -> DataFrame:
    """key, level, index, digest, peak of all nodes that can be made out of a run by itself, its leaves included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, now, out = Mountains(fanout), (None, None, None), []
        for b in batches:
            for key, part, index, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, part, index) != now:  # another run, as those have frames of their own; or a run's rows in two tasks
                    out += [(now[0], *x) for x in m.rest()]
                out += [(key, *x) for x in m.add(index, digest.encode())]
                now = key, part, index + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)
            out = []
        out = [(now[0], *x) for x in m.rest()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    names, types = ["key", "level", "index", "digest", "peak"], [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    given = leaves.select("key", "part", "index", "leaf").sortWithinPartitions("part", "key", "index")
    return given.mapInArrow(run, "key string, level int, index long, digest binary, peak boolean")


def merged(nodes: DataFrame, runs: DataFrame, fanout: int) -> DataFrame:
    """key, level, index, digest of the peaks among nodes and of all nodes over them."""
    sizes = runs.where("start = 0").select("key", "n")
    most = sizes.agg(F.max("n")).first()[0] or 0
    done = stash(nodes.where("peak").drop("peak").join(sizes, "key"), "merkle-peaks")
    now, top = done, 0

    def up(to: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            found = defaultdict(dict)
            for level, k, d in zip(group["level"], group["index"], group["digest"], strict=True):
                found[level][k] = bytes(d)
            n = int(group["n"].iloc[0])
            made = [*merge(found, n, to, fanout)]
            return pd.DataFrame({"key": group["key"].iloc[0], "level": [x[0] for x in made], "index": [x[1] for x in made], "digest": [x[2] for x in made], "n": n})

        return run

    while top < (depth(most, fanout) if most else 0):
        top += STEP
        block = F.floor(F.col("index") / F.pow(F.lit(float(fanout)), F.lit(top) - F.col("level"))).alias("block")
        low = now.where(F.col("level") < top)
        made = stash(low.groupBy("key", block).applyInPandas(up(top), low.schema), "merkle-merged")
        done = done.unionByName(made)
        now = now.where(F.col("level") >= top).unionByName(made.where(F.col("level") == top))
    return done.drop("n")


def frames(runs: DataFrame, nodes: DataFrame, fanout: int) -> DataFrame:
    """runs with `frame`: (level, index, digest) of the peaks and merged nodes around the first and the last leaf."""
    most = runs.agg(F.max("n")).first()[0] or 1
    at = lambda x: F.floor(x / F.pow(F.lit(float(fanout)), F.col("level") + 1)) * fanout
    wide = F.ceil(F.col("n") / F.pow(F.lit(float(fanout)), F.col("level")))
    near = lambda x: F.sequence(at(x), F.least(at(x) + fanout, wide) - 1)
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(1, depth(most, fanout)) - 1))).alias("level")
    asked = runs.select("part", "key", "n", "start", "size", levels).where(wide > 1)
    asked = asked.select("part", "key", "level", F.explode(F.array_union(near(F.col("start")), near(F.col("start") + F.col("size") - 1))).alias("index"))
    found = asked.join(nodes, ["key", "level", "index"]).groupBy("part", "key").agg(F.collect_list(F.struct("level", "index", "digest")).alias("frame"))
    return runs.join(found, ["part", "key"], "left")


class Run:
    """The siblings of a run's leaves: its own nodes and those of its frame."""

    def __init__(self, start: int, leaves: list[bytes], n: int, frame: list[dict] | None, fanout: int):
        self.fanout, self.n, self.depth = fanout, n, depth(n, fanout)
        self.nodes = [{} for _ in range(self.depth + 1)]
        for x in frame or ():
            self.nodes[x["level"]][x["index"]] = x["digest"]
        self.nodes[0].update(enumerate(leaves, start))
        first, past = start, start + len(leaves)
        for level in range(self.depth):
            here, wide = self.nodes[level], width(n, level, fanout)
            first, past = -(-first // fanout), -(-past // fanout) if past == wide else past // fanout
            for k in range(first, past):
                self.nodes[level + 1][k] = combine(here[j] for j in range(k * fanout, min((k + 1) * fanout, wide)))

    def path(self, index: int) -> list[tuple[int, list[bytes]]]:
        """Of each level a leaf's ancestor's place in its run of siblings, and the others."""
        out = []
        for level in range(self.depth):
            first = index - index % self.fanout
            run = range(first, min(first + self.fanout, width(self.n, level, self.fanout)))
            out.append((index - first, [self.nodes[level][k] for k in run if k != index]))
            index //= self.fanout
        return out


def climb(digest: bytes, path: Iterable[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf's digest and its path give."""
    for place, others in path:
        digest = combine([*others[:place], digest, *others[place:]])
    return digest


class Tree:
    """A tree for each key over rows (key, id, leaf and others): its nodes, and each leaf's path."""

    def __init__(self, rows: DataFrame, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("a fanout of 2 at least is needed")
        ship(rows.sparkSession)
        self.fanout = fanout
        self.leaves, self.runs = ordered(rows, fanout)
        self.settled = stash(peaks(self.leaves, fanout), "merkle-nodes")
        self.edges = merged(self.settled, self.runs, fanout)

    def nodes(self) -> DataFrame:
        """key, level, index, digest (hexadecimal) of all nodes; leaves are of level 0."""
        found = self.edges.unionByName(self.settled.where("not peak").drop("peak"))
        return found.withColumn("digest", F.col("digest").cast("string"))

    def roots(self) -> DataFrame:
        """key, root (hexadecimal), n."""
        top = self.edges.groupBy("key").agg(F.max_by(F.col("digest").cast("string"), "level").alias("root"))
        return top.join(self.runs.where("start = 0").select("key", "n"), "key")

    def paths(self, rows: Callable[[dict], Callable[[dict, list], tuple]], columns: dict[str, tuple[str, pa.DataType | None]], above: DataFrame | None = None) -> DataFrame:
        """A row for each leaf, of the columns named (with Spark's and Arrow's type; none: the type of id).

        rows gets each run (with its key's row of `above`) and returns what makes a row of a leaf's row and its path.
        """
        given = frames(self.runs, self.edges, self.fanout)
        if above is not None:
            given = given.join(above, "key")
        fanout = self.fanout

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            (own,) = right.to_pylist()
            leaves = left.sort_by("index").to_pylist()
            tree, row = Run(own["start"], [x["leaf"].encode() for x in leaves], own["n"], own["frame"], fanout), rows(own)
            out = [row(x, tree.path(x["index"])) for x in leaves]
            return pa.table({c: pa.array([x[k] for x in out], t or left.schema.field("id").type) for k, (c, (_, t)) in enumerate(columns.items())})

        return self.leaves.groupBy("part", "key").cogroup(given.groupBy("part", "key")).applyInArrow(run, ", ".join(f"{c} {t}" for c, (t, _) in columns.items()))


def source_key(source: Column) -> Column:
    """A string for each source, in the order of sources: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def tampered(doc_id: Column, text: Column) -> Column:
    """Texts without their line ends where the id's checksum is even; others, and those of null ids, as they are."""
    return F.when(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(2)) == 0, F.translate(text, "\n", "")).otherwise(text)


def leaves(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """key, id, leaf and tampered (the leaf of the row with its text tampered with) of each row."""
    changed = tampered(docs[id_col], docs[text_col])
    return docs.select(source_key(docs[source_col]).alias("key"), docs[id_col].alias("id"), leaf(*(docs[c] for c in fields)).alias("leaf"), leaf(*(changed if c == text_col else docs[c] for c in fields)).alias("tampered"))


def manifest(docs: DataFrame, fanout: int = FANOUT, **columns) -> tuple[Tree, Tree]:
    """The trees of the sources' rows and of the sources' roots (whose only key is empty)."""
    rows = Tree(stash(leaves(docs, **columns), "merkle-rows"), fanout)
    roots = rows.roots().select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("root").alias("leaf"))
    return rows, Tree(stash(roots, "merkle-roots"), fanout)


def proofs(docs: DataFrame, fanout: int = FANOUT, **columns) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    rows, sources = manifest(docs, fanout, **columns)

    text, levels = ("string", pa.string()), pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))

    def of_sources(_):
        def row(given, path):
            said = [{"place": p, "others": [x.decode() for x in others]} for p, others in path]
            return given["id"], given["leaf"], climb(given["leaf"].encode(), path).decode(), said

        return row

    above = sources.paths(of_sources, {"key": text, "subroot": text, "root": text, "above": ("array<struct<place:int,others:array<string>>>", levels)})

    def of_rows(own):
        higher = [(x["place"], [y.encode() for y in x["others"]]) for x in own["above"]]

        def row(given, path):
            path += higher
            folded = climb(given["tampered"].encode(), path).decode()
            return given["id"], given["leaf"], own["subroot"], own["root"], combine(x for _, others in path for x in others).decode(), folded, folded == own["root"]

        return row

    kinds = {"doc_id": (dict(rows.leaves.dtypes)["id"], None), "leaf": text, "subroot": text, "root": text, "proof_sha256": text, "folded_root": text, "verified": ("boolean", pa.bool_())}
    return rows.paths(of_rows, kinds, stash(above, "merkle-above"))
