"""Running totals over all rows in an order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.session import stash


def running(df: DataFrame, order: Column | str, totals: dict[str, Column]) -> DataFrame:
    """df with columns of the totals of all rows up to each (itself included). Rows of one order value should be one row.

    Rows are dealt by ranges of the order, and written so that later steps see the same ranges; each range adds up its
    own rows, and to these the totals of the ranges before, of which there are as many as partitions.
    """
    part = "__range"
    placed = stash(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranges")
    held = placed.groupBy(part).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(part, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in totals])
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(F.broadcast(offsets), part)
    return found.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"__{n}")).alias(n) for n, c in totals.items()])


def numbered(df: DataFrame, order: Column | str, name: str) -> DataFrame:
    """df with dense numbers from 0 in an order in which no two rows are equal."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with numbers from 0 of each key's rows in an order, whatever share of all rows a key has: rows are numbered
    by ranges of (keys, order), and the first number of each key is subtracted, which is a join with a row for a key."""
    placed = stash(numbered(df.withColumn("__order", F.struct(*keys, *order)), "__order", "__at").drop("__order"), "numbered")
    same = [f"__key{k}" for k in range(len(keys))]
    first = placed.groupBy(*keys).agg(F.min("__at").alias("__base")).select(*[F.col(c).alias(s) for c, s in zip(keys, same, strict=True)], "__base")
    on = [F.col(c).eqNullSafe(F.col(s)) for c, s in zip(keys, same, strict=True)]
    return placed.join(first, on).select(*df.columns, (F.col("__at") - F.col("__base")).cast("int").alias(name))
