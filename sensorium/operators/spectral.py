"""Normalised operators of undirected graphs, the largest singular value of an edge frame, and Chebyshev rescaling.

Edges are (src, dst, weight). Nothing is made dense: a product with a vector is a join on one end and a sum by the
other. A power iteration deals the edges into cells by dst once, as a bucketed table in the shared folder; its rounds
shuffle sums of nodes only, and write their vectors to that folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorium.session import setting, stash_bucketed, unstash

from .adjacency import combined, over_degrees


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair with the larger weight of its two directions; a direction without an edge counts as 0."""
    one = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    turned = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = one.unionByName(turned).groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    alone = (F.col("n") == 1) & (F.col("weight") < 0)
    return both.select("src", "dst", F.when(alone, 0.0).otherwise(F.col("weight")).alias("weight")).where("weight <> 0")


def loops(nodes: DataFrame, weight: float = 1.0) -> DataFrame:
    """An edge of each node (room_uri) to itself."""
    return nodes.select(F.col("room_uri").alias("src"), F.col("room_uri").alias("dst"), F.lit(weight).alias("weight"))


def normalised_operator(edges: DataFrame, kind: str, nodes: DataFrame) -> DataFrame:
    """Edges of the operator of the undirected graph over nodes (room_uri).

    kind is {sym,rw}_{norm,renorm}_{adj,lap}: weights over the roots of both ends' sums, or over src's sum (nodes
    without any count as 0); renorm adds 1 to each node's loop first; lap subtracts the result from loops of weight 1.
    """
    by, loop, result = ([*kind.split("_"), "", ""])[:3]
    if by not in ("sym", "rw") or loop not in ("norm", "renorm") or result not in ("adj", "lap"):
        raise ValueError(f"unknown kind {kind}")
    e = undirected(edges)
    if loop == "renorm":
        e = combined(e, loops(nodes))
    out = over_degrees(e, e.groupBy(F.col("src").alias("n")).agg(F.sum("weight").alias("d")), by)
    return combined(loops(nodes), out.withColumn("weight", -F.col("weight"))) if result == "lap" else out


#: Edges that a cell should have at most; small matrices have as many cells as tasks can run at once.
CELL_EDGES = 3_000_000


def cell_numbers(spark: SparkSession, n: int) -> list[int]:
    """n longs, of which a shuffle into n partitions puts each into one of its own."""
    by_place = spark.range(32 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id").alias("id"))
    return sorted(r.id for r in by_place.collect())


def cell_of(node: str, numbers: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, numbers)), (F.pmod(F.xxhash64(node), F.lit(len(numbers))) + 1).cast("int")).cast("long")


def gram_product(cells: DataFrame, x: DataFrame, scale: float = 1.0) -> DataFrame:
    """cell, dst, x, whole, old: the matrix's transpose times the matrix times (scale times) the vector x (cell, dst, x).

    cells (cell, src, dst, weight) and x are stored by cell and stay where they are: shuffled are only a cell's sums for
    the src nodes that it has, to be added up over all cells, and back. whole counts the node without a name (src
    null) too, so that its product with old, the vector given, is the squared length of the matrix times it.
    """
    given = x.select("cell", "dst", (F.col("x") * scale).alias("old"))
    # a left join, so that src nodes come to cells of theirs in which the vector is empty
    here = cells.join(given.hint("shuffle_hash"), ["cell", "dst"], "left").groupBy("cell", "src").agg(F.sum(F.col("weight") * F.col("old")).alias("y"))
    y = here.select("cell", "src", F.sum("y").over(Window.partitionBy("src")).alias("y")).alias("y").hint("shuffle_hash")
    both = cells.alias("c").join(y, (F.col("c.cell") == F.col("y.cell")) & F.col("c.src").eqNullSafe(F.col("y.src")))
    part = F.col("weight") * F.col("y")
    out = both.groupBy("c.cell", "c.dst").agg(F.sum(F.when(F.col("c.src").isNotNull(), part)).alias("x"), F.sum(part).alias("whole"))
    return out.join(given.hint("shuffle_hash"), ["cell", "dst"], "left")


def largest_singular_value(edges: DataFrame, start: DataFrame | None = None, tolerance: float = 1e-9, rounds: int = 200) -> tuple[float, int]:
    """(value, rounds taken) of a power iteration, which ends when a round changes the value by less than the tolerance
    (a share of it), or after so many rounds.

    Each round multiplies by the matrix, which gives the estimate, and by its transpose. start: (node, x) over dst
    nodes; by default between 1/2 and 3/2 by a hash of the node, so that no symmetry of the graph is met. Edges that
    are given several times are added up. They are dealt by dst once and not shuffled again; a round shuffles each
    src node once for each cell that has it, so matrices with many more src nodes than dst nodes should be turned.
    """
    spark = edges.sparkSession
    numbers = cell_numbers(spark, max(spark.sparkContext.defaultParallelism, edges.count() // CELL_EDGES + 1))
    n = len(numbers)
    dealt = edges.select(cell_of("dst", numbers).alias("cell"), "src", "dst", "weight").repartition(n, "cell")
    cells = stash_bucketed(dealt.groupBy("cell", "src", "dst").agg(F.sum("weight").alias("weight")), "cells", n, "cell")
    if start is None:
        share = F.pmod(F.xxhash64("dst"), F.lit(1 << 20)) / float(1 << 20) + 0.5
        start = cells.select("dst").distinct().select(F.col("dst").alias("node"), share.alias("x"))
    x = stash_bucketed(start.select(cell_of("node", numbers).alias("cell"), F.col("node").alias("dst"), "x").repartition(n, "cell"), "vector", n, "cell")
    square, scale, value, done = x.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0, 1.0, 0.0, 0
    for done in range(1, rounds + 1):
        # a join by cell and node shuffles neither side that is stored by cell
        with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            old, x = x, stash_bucketed(gram_product(cells, x, scale), "vector", n, "cell")
        unstash(old)
        grown, after = x.agg(F.sum(F.col("whole") * F.col("old")), F.sum(F.col("x") * F.col("x"))).first()
        last, value = value, (math.sqrt(max(grown or 0.0, 0.0) / square) if square else 0.0)
        if not value or abs(value - last) <= tolerance * value:
            break
        square, scale = (1.0, 1.0 / math.sqrt(after)) if after else (0.0, 1.0)
    unstash(cells, x)
    return value, done


def chebyshev_operator(operator: DataFrame, nodes: DataFrame, largest: float | None = None) -> DataFrame:
    """The operator with its spectrum moved to [-1, 1]: 2 / largest of it (as it is from 2 on), less a loop of each node."""
    if largest is None:
        largest, _ = largest_singular_value(operator)
    if largest <= 0:
        raise ValueError("an operator without weights can't be rescaled")
    scale = 1.0 if largest >= 2 else 2.0 / largest
    return combined(operator.select("src", "dst", (F.col("weight") * scale).alias("weight")), loops(nodes, -1.0))
