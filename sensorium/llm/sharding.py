"""Sharding by a hierarchical weighted hash tree.

A row descends from the regions to a region's racks to a rack's shards, by the least draw at each level. A shard draws
-ln(u) / weight, u being a hash of the row's id and the shard's number in (0, 1]; a rack's draw is the least of its
shards', and a region's the least of its racks', which is distributed as one draw with the sum of their weights. So a
child gets its weight's share on each level, and the shard at the end is the one with the least draw of all. If a
weight changes, rows move only into (or out of) the shards whose weights change, within the racks and regions that
hold them; the same is true of a shard that is added or taken away, wherever in the tree. The law is `key`: the id and
the shard count decide, as the tree of n shards is always the same one, whatever other rows there are.

Slots number the rows of a shard from 0 without gaps, by id. They come from a sort by (shard, id) over all tasks:
a row's slot is its place in its partition plus the rows of its shard in the partitions before.

Cases: a null text has no bytes (size 1) and the checksum of an empty one; a null id draws as a key of its own; rows
with equal ids go to one shard and have slots of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int, racks_of: int = 2, regions_of: int = 2) -> Tree:
    """Shards 0 to shards - 1 in racks of two and regions of two racks; the last ones may have fewer. Each tree holds
    the smaller ones: a shard more comes into the last rack, or a new one, or a new region."""
    out: Tree = {}
    for k in range(shards):
        region = f"region{k // (racks_of * regions_of)}"
        out.setdefault(region, {}).setdefault(f"{region}/rack{k // racks_of}", {})[k] = 1.0
    return out


def leaves(node) -> list[tuple[int, float]]:
    """(shard, weight) of all shards below a node that have weight."""
    if not isinstance(node, dict):
        raise TypeError("a tree is a dict of weights or of dicts")
    return [x for name, below in node.items() for x in (leaves(below) if isinstance(below, dict) else [(name, below)]) if x[1] > 0]


def draw(key: Column, name: str, w: float) -> Column:
    """-ln(u) / w of a shard, u in (0, 1] by the upper 53 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key.isNull(), key), 11).cast("double") + 1) / float(1 << 53)
    return -F.log(u) / w


def shard_of(key: Column, node) -> Column:
    """The shard that a key comes to: at each level the child with the least draw, which is the one that holds the
    least draw of all shards. Weightless shards get nothing."""
    found = leaves(node)
    if not found:
        raise ValueError("a tree needs a shard with weight")
    drawn = [F.struct(draw(key, f"shard{s}", w).alias("draw"), F.lit(s).cast("int").alias("shard")) for s, w in found]
    return F.array_min(F.array(*drawn))["shard"]


def numbered(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """rows with `slot`: their number within the shard, from 0, by order. Ties are broken arbitrarily."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    # the range partitions split even rows that agree in everything but the last key
    dealt = tie.repartitionByRange(n, shard, *order, "__tie").sortWithinPartitions(shard, *order, "__tie").drop("__tie")
    place = F.monotonically_increasing_id()
    dealt = stash(dealt.withColumn("__at", place).withColumn("__part", F.shiftright("__at", 33)), "sharded")
    runs = dealt.groupBy("__part", shard).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # a few rows a task
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    joined = dealt.join(runs, ["__part", shard], "inner")
    return joined.withColumn("slot", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def shards(docs: DataFrame, now: Tree, then: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    whole = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), now), "grown_shard": shard_of(F.col("doc_id"), then)})
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
