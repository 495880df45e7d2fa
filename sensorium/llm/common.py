"""What the operators share: reading, tables in the shared folder, hot keys, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorium.session import ship, stash, unstash

#: Rows sent to a Python worker at once; texts can be long, so few.
ARROW_ROWS = "512"

#: A 256-entry table for bytes.translate: A-Z lower-cased, other ASCII that is no letter or digit becomes a space.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of a string column; a longer string is a slice of its own."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(column)), 0).cast(pa.int64())).to_numpy()
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


def small_batches(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def attach(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, most: int = 20_000) -> DataFrame:
    """rows joined (inner) with classes on keys, whatever the sizes of the classes.

    classes holds one row for each key and in `size` its number of rows. Classes of more than one row in `most`, which
    are fewer than `most`, are broadcast; the others are joined by a shuffle, where no key is hot. Both frames should
    be stashed ones, as each is read twice.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    limit = total // most + 1
    hot, rest = classes.where(F.col(size) > limit), classes.where(F.col(size) <= limit)
    few = rows.join(F.broadcast(hot), keys, "inner")
    many = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "inner")
    return few.unionByName(many)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that tell rows apart by id and text (128 bits of hash for the text)."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id.isNull(), doc_id, whole).alias("__k1"), F.xxhash64(F.lit(7), doc_id.isNull(), doc_id, whole).alias("__k2")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    held = {c.lower() for c in df.columns}
    return [next(x for k in range(len(held) + 1) if (x := n + "_" * k).lower() not in held) for n in names]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with their row keys, and the names of these two columns."""
    names = fresh(docs, "__k1", "__k2")
    return docs.select("*", *[c.alias(n) for c, n in zip(row_key(docs[id_col], docs[text_col]), names, strict=True)]), names


def only_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose row_key is in keys (__k1, __k2); of identical rows, one."""
    own, (k1, k2) = keyed(docs, id_col, text_col)
    (n,) = fresh(own, "__n")
    found = own.join(keys.select(F.col("__k1").alias(k1), F.col("__k2").alias(k2)), [k1, k2], "inner")
    one = Window.partitionBy(k1, k2).orderBy(k1, k2)
    return found.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*docs.columns)


#: Edges that a task of components() should have at least.
EDGES_A_TASK = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long nodes: (node, root), root the component's least node.

    Rounds of joining each node's larger neighbours, then its smaller ones, to the least node around it; each
    round is a table in the shared folder, and deletes those of the round before. Nodes with many edges go through
    attach. Edges get no more, so tables of few edges are written by few tasks. An empty graph gives no rows.
    """
    u, v = F.col(a), F.col(b)
    edges = stash(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")), "edges")
    tasks = edges.count() // EDGES_A_TASK + 1
    kept = lambda df, name: stash(df.coalesce(tasks), name)
    now = kept(edges.distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    done, after = None, mark(now)
    old = [edges]
    while after != done:
        done = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("deg")), "least")
        wide = attach(both, least, ["u"], "deg").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = kept(wide.where("u <> v").distinct(), "edges")
        less = kept(wide.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")), "least")
        near = attach(wide, less, ["u"], "deg").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = near.unionByName(less.select("u", F.col("m").alias("v")))
        old += [now, least, wide, less]
        now = kept(near.where("u <> v").distinct(), "edges")
        unstash(*old)
        old, after = [], mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
