"""Kendall's rank correlation by counting inversions over range partitions, not pairs.

Rows are counted by (x, y) and dealt by ranges of (x, y), so that a range's rows come before those of later ones.
Inversions (a greater y before a smaller one) within a range are counted in its task by merges; those between ranges by
a tree: FAN ranges are siblings, then FAN such groups, and so on. On each level the siblings' counts of each y are
totalled up along y, again over ranges (`ordered.running`); what an earlier sibling has beyond a y is inverted with it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.session import ship, stash

from .ordered import running

#: Ranges that are compared on one level of the tree.
FAN = 16


def inversions(y: np.ndarray, n: np.ndarray) -> int:
    """Of values in order, each n times, the number of pairs with the greater one first: merges of doubling width."""
    _, rank = np.unique(y, return_inverse=True)
    at, width, total = np.arange(len(rank)), 1, 0
    while width < len(rank):
        pair, right = at // (2 * width), (at // width) % 2
        order = np.lexsort((right, rank, pair))  # equal values: the left ones first, as they aren't inverted
        weight, is_right = n[order], right[order].astype(bool)
        left = np.cumsum(np.where(is_right, 0, weight))
        ends = np.cumsum(np.bincount(pair)) - 1
        total += int(((left[ends][pair[order]] - left) * weight)[is_right].sum())
        width *= 2
    return total


def _within(dealt: DataFrame) -> DataFrame:
    """pairs: the inversions of each range."""

    def run(rows: pa.Table) -> pa.Table:
        x, y, n = (rows.column(c).to_numpy() for c in ("x", "y", "n"))
        order = np.lexsort((y, x))
        return pa.table({"pairs": pa.array([inversions(y[order], n[order])], pa.int64())})

    ship(dealt.sparkSession)
    return dealt.select("part", "x", "y", "n").groupBy("part").applyInArrow(run, "pairs long")


def _between(dealt: DataFrame, level: int, fan: int) -> int:
    """The inversions between the siblings of a level of the tree."""
    size = fan**level
    child = F.floor(F.col("part") / size) % fan
    own = [f"n{k}" for k in range(fan)]
    rows = dealt.groupBy(F.struct(F.floor(F.col("part") / (size * fan)).alias("block"), "y").alias("at")).agg(*[F.sum(F.when(child == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(own)])
    upto = [f"u{k}" for k in range(fan)]
    rows = stash(running(rows, "at", {u: F.col(c) for u, c in zip(upto, own, strict=True)}).withColumn("block", F.col("at.block")), "inversions")
    whole = rows.groupBy("block").agg(*[F.max(u).alias(f"t{k}") for k, u in enumerate(upto)])  # a row for each block of ranges
    beyond, inverted = F.lit(0), F.lit(0)
    for k, (c, u) in enumerate(zip(own, upto, strict=True)):
        inverted = inverted + F.col(c) * beyond
        beyond = beyond + F.col(f"t{k}") - F.col(u)
    return rows.join(F.broadcast(whole), "block").agg(F.sum(inverted.cast("decimal(38,0)"))).first()[0] or 0


def kendall(df: DataFrame, x: str, y: str, fan: int = FAN) -> float | None:
    """tau-b of two columns over the rows that have both (NaN counts as NULL); None where one of them doesn't vary."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    counted = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    dealt = stash(counted.repartitionByRange("x", "y").withColumn("part", F.spark_partition_id()), "ranked-pairs")
    pairs = F.sum(F.shiftright(F.col("n") * (F.col("n") - 1), 1).cast("decimal(38,0)"))
    ties = lambda *cols: int(dealt.groupBy(*cols).agg(F.sum("n").alias("n")).agg(pairs).first()[0] or 0)
    rows, ranges = dealt.agg(F.sum("n"), F.max("part")).first()
    whole, in_x, in_y, in_both = (rows or 0) * ((rows or 0) - 1) // 2, ties("x"), ties("y"), ties("x", "y")
    if in_x == whole or in_y == whole:
        return None
    discordant = _within(dealt).agg(F.sum("pairs")).first()[0] or 0
    level = 0
    while fan**level <= ranges:
        discordant += _between(dealt, level, fan)
        level += 1
    discordant = int(discordant)
    return (whole - in_x - in_y + in_both - 2 * discordant) / (((whole - in_x) * (whole - in_y)) ** 0.5)


def kendall_matrix(df: DataFrame, cols: list[str], fan: int = FAN) -> DataFrame:
    """a, b, r of each pair of columns, as reports.correlations gives them."""
    rows = [(a, b, kendall(df, a, b, fan)) for a, b in combinations(cols, 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
