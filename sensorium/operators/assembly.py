"""Floors put together to a building, complete or not at all.

What is missing is found by anti-joins inside the plan: rows of a check belong to the result's union, and their filter
and columns raise when they meet one. So nothing is computed beforehand, and columns or rows of the result that aren't
wanted can't take the check away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions import geometry as g


def failing(df: DataFrame, rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """df; a job over it fails with the message of one of the rows for which bad holds, if there are any."""
    lost = F.when(bad, F.raise_error(message))  # not a filter before it, as the optimiser may put one behind
    return df.unionByName(rows.where(lost.isNotNull()).select(*[lost.cast(f.dataType).alias(f.name) for f in df.schema]))


def complete_rooms(rooms: DataFrame, area: str | None = None) -> DataFrame:
    """room_uri, floor_number, points and area of rooms with an outline (three points at least).

    Rooms without an area, or without a floor, make the job fail; those without an outline are left out, as a plan may
    lack them. area names a column that has it; without one it is the outline's, and a room without outline fails.
    """
    own = F.col(area) if area else F.when(F.size("points") >= 3, g.area(F.col("points")))
    rows = rooms.select("room_uri", "floor_number", "points", own.cast("double").alias("area"))
    lost = F.col("area").isNull() | F.col("floor_number").isNull()
    what = F.when(F.col("area").isNull(), "area").otherwise("floor")
    good = rows.where(~lost & (F.size("points") >= 3))
    return failing(good, rows, lost, F.concat(F.lit("room "), F.coalesce("room_uri", F.lit("?")), F.lit(" has no "), what))


def block_diagonal(floors: dict[int, tuple[DataFrame, DataFrame]], rooms: DataFrame) -> DataFrame:
    """src, dst, weight of all floors' edges: the building's matrix, whose blocks the floors are.

    floors has for each number the rooms (room_uri) of its matrix and its edges. The job fails if a room of `rooms`
    (room_uri) is in no floor's matrix or in two, or an edge has an end that isn't in its floor's matrix.
    """
    if not floors:
        raise ValueError("no floors")
    tag = lambda df, n, *cols: df.select(F.lit(n).alias("floor"), *cols)
    members = reduce(DataFrame.unionByName, [tag(own, n, "room_uri") for n, (own, _) in floors.items()])
    edges = reduce(DataFrame.unionByName, [tag(e, n, "src", "dst", "weight") for n, (_, e) in floors.items()])
    places = members.groupBy("room_uri").agg(F.countDistinct("floor").alias("n"))
    out = edges.select("src", "dst", "weight")
    asked = rooms.select("room_uri").distinct().join(places, "room_uri", "left")
    out = failing(out, asked, F.coalesce(F.col("n") > 1, F.lit(True)), F.concat(F.lit("room "), "room_uri", F.when(F.col("n").isNull(), " is in no floor's matrix").otherwise(" is in several floors' matrices")))
    ends = edges.select("floor", F.explode(F.array("src", "dst")).alias("room_uri")).distinct()
    known = ends.join(members.distinct().withColumn("known", F.lit(True)), ["floor", "room_uri"], "left")
    return failing(out, known, F.col("known").isNull(), F.concat(F.lit("an edge of floor "), F.col("floor").cast("string"), F.lit(" ends at "), "room_uri"))
