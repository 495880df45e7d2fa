"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition makes a run: its entries (digest, length, smallest identifier, count) sorted by digest, equal ones
merged. In each round FAN_IN runs come together in their parent: entries are exchanged by (parent, digest), so that a
task gets a part of each child's run and no task holds a whole one; the parts are merged by sorting them together, and a
pass over the sorted entries keeps, of those that agree in digest (SHA-256) and length, the first, which has the
smallest identifier, with the sum of their counts. So identifiers are verified and counts complete at every level, and
a text with copies in a third of all rows is one entry of each run from the start. With up to FAN_IN input partitions
there is one round; each further one sixteenfolds what is merged.

Cases: a null text counts as empty; empty texts form one group. Rows with a null id are part of their group, after
all others; identical rows (same id, same text) are told apart, and just one is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.session import ship

from .common import attach, only_rows, row_key, stash

FAN_IN = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of docs: __id, row key, digest, length, and uid, its number in this table."""
    same = normalised(docs[text_col])
    frame = docs.select(docs[id_col].alias("__id"), *row_key(docs[id_col], docs[text_col]), F.unhex(F.sha2(same, 256)).alias("digest"), F.octet_length(same).alias("n_bytes"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("uid"))
    return stash(frame, "digests")


ORDER = ["run", "digest", "n_bytes", "none", "id", "uid"]


def keep_least(entries: DataFrame) -> DataFrame:
    """Of entries in ORDER within their partitions, the first of each run, digest and length, with all their counts."""

    def merged(b: pa.RecordBatch) -> pa.RecordBatch:
        new = np.ones(b.num_rows, bool)
        new[1:] = False
        for c in ORDER[:3]:
            x = b.column(c)
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        first, n = b.take(pa.array(starts)), np.add.reduceat(b.column("n").to_numpy(), starts)
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()) if c == "n" else first.column(c) for c in first.schema.names], schema=b.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last entry, whose equals may go on in the next batch
        for b in batches:
            if b.num_rows:
                out = merged(pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0])
                yield out.slice(0, out.num_rows - 1)
                held = [out.slice(out.num_rows - 1)]
        yield from held

    return entries.mapInArrow(run, entries.schema)


def merged_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The root run of the tree: (digest, n_bytes, first, n), first being (has no id, id, uid) of the row that stays."""
    if fan_in < 2:
        raise ValueError("a parent needs two runs at least")
    ship(rows.sparkSession)
    here = rows.select("run", "digest", "n_bytes", F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "uid", F.lit(1).cast("long").alias("n"))
    here = stash(keep_least(here.sortWithinPartitions(*ORDER)), "runs")
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        parents = here.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        here = stash(keep_least(parents.repartition("run", "digest").sortWithinPartitions(*ORDER)), "runs")
        left = -(-left // fan_in)
        if left == 1:
            return here.select("digest", "n_bytes", F.struct("none", "id", "uid").alias("first"), "n")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """A row for each row of docs: __id, __k1, __k2, digest, n_bytes, keep_id, group_size, kept."""
    rows = digests(docs, id_col, text_col)
    found = attach(rows, merged_runs(rows, fan_in), ["digest", "n_bytes"], "n")
    return found.select("__id", "__k1", "__k2", "digest", "n_bytes", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("first.uid")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, all columns as they were."""
    return only_rows(docs, decisions(docs, id_col, text_col).where("kept"), id_col, text_col)
