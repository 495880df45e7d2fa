"""Adjacency of rooms as edge frames: within floors, between floors, to the outside, and what can be reached."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions import geometry as g
from sensorium.session import ship, stash

from .calendar import dense_index


#: Cells are at least this wide.
CELL = 20.0


def sides(rooms: DataFrame, s: str) -> DataFrame:
    """room_uri, floor_number and points of rooms with bounds, and whether these are their outline, each prefixed."""
    ship(rooms.sparkSession)
    pts = F.col("points")
    return rooms.select(F.col("room_uri").alias(f"{s}_room"), F.col("floor_number").alias(f"{s}_floor"), pts.alias(f"{s}_points"), g.bounds(pts).alias(f"{s}_box"), g.is_box(pts).alias(f"{s}_boxed"))


def _apart(reach: Column | float) -> Column:
    """Whether two boxes are no further apart than reach on each axis: what any near pair fulfils."""
    a, b = F.col("a_box"), F.col("b_box")
    return (a.x0 <= b.x1 + reach) & (b.x0 <= a.x1 + reach) & (a.y0 <= b.y1 + reach) & (b.y0 <= a.y1 + reach)


def _box_distance() -> Column:
    a, b, zero = F.col("a_box"), F.col("b_box"), F.lit(0.0)
    x, y = F.greatest(zero, a.x0 - b.x1, b.x0 - a.x1), F.greatest(zero, a.y0 - b.y1, b.y0 - a.y1)
    return F.sqrt(x * x + y * y)


def _box_overlap() -> Column:
    a, b, zero = F.col("a_box"), F.col("b_box"), F.lit(0.0)
    return F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def _in_cells(own: DataFrame, s: str, size: float, reach: float) -> DataFrame:
    """Sides with the grid cells (cx, cy) that their boxes touch, widened by reach."""
    at = lambda v, w: F.floor((v + w) / size)
    box = F.col(f"{s}_box")
    return own.withColumn("cx", F.explode(F.sequence(at(box.x0, -reach), at(box.x1, reach)))).withColumn("cy", F.explode(F.sequence(at(box.y0, -reach), at(box.y1, reach))))


def _met(a: DataFrame, b: DataFrame, size: float, reach: float) -> DataFrame:
    """Pairs of a floor (a_floor of both) whose boxes are within reach: an equi-join on floor and grid cell.

    Each pair is kept in one of its common cells only: the one with the least numbers that both touch. Files of rooms are
    small for the work that pairs are, so that Spark would broadcast one side and leave the pairs to a task or two.
    """
    pairs = _in_cells(a, "a", size, reach).join(_in_cells(b, "b", size, 0.0).hint("merge"), ["a_floor", "cx", "cy"]).where(_apart(reach))
    x = F.greatest(F.floor((F.col("a_box").x0 - reach) / size), F.floor(F.col("b_box").x0 / size))
    y = F.greatest(F.floor((F.col("a_box").y0 - reach) / size), F.floor(F.col("b_box").y0 / size))
    return pairs.where((F.col("cx") == x) & (F.col("cy") == y)).drop("cx", "cy")


def near_pairs(rooms: DataFrame, reach: float, cell: float | None = None) -> DataFrame:
    """Pairs (a before b by uri) of a floor whose boxes are within reach."""
    a, b = sides(rooms, "a").drop("a_boxed"), sides(rooms, "b").drop("b_boxed").withColumnRenamed("b_floor", "a_floor")
    pairs = _met(a, b, cell or max(4 * reach, CELL), reach).where("a_room < b_room")
    return pairs.withColumnRenamed("a_floor", "floor_number")


def _by_shape(a: DataFrame, b: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Pairs as _met, of boxes only (without their points), and those with another shape among them.

    What two boxes have in common is an expression; only the others have to go through Arrow functions."""
    size = max(4 * reach, CELL)
    boxes = _met(a.where("a_boxed").drop("a_points"), b.where("b_boxed").drop("b_points"), size, reach)
    others = _met(a.where("not a_boxed"), b, size, reach).unionByName(_met(a.where("a_boxed"), b.where("not b_boxed"), size, reach))
    return boxes, others


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def _both(a: Column | str, b: Column | str) -> Column:
    """The edge of a pair in both directions, with a weight for each: (src, dst, weight) rows of one pass over pairs."""
    edge = lambda s, d, w: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), w.alias("weight"))
    return F.inline(F.array(edge("a_room", "b_room", a), edge("b_room", "a_room", b)))


def horizontal_binary(rooms: DataFrame, threshold: float = 5.0) -> DataFrame:
    """src, dst, weight 1 of rooms of a floor no further apart than the threshold."""
    boxes, others = _by_shape(sides(rooms, "a"), sides(rooms, "b").withColumnRenamed("b_floor", "a_floor"), threshold)
    near = boxes.where((_box_distance() <= threshold) & (F.col("a_room") < F.col("b_room"))).select("a_room", "b_room")
    near = near.unionByName(others.where("a_room < b_room").where(g.polygon_distance("a_points", "b_points") <= threshold).select("a_room", "b_room"))
    return near.select(_both(F.lit(1.0), F.lit(1.0)))


def horizontal_weighted(rooms: DataFrame, threshold: float = 5.0, min_shared: float = 0.01, min_weight: float = 0.0) -> DataFrame:
    """src, dst, weight: the share of src's boundary within half the threshold of dst's boundary, for rooms within
    the threshold. Shares no longer than min_shared get min_weight, and edges without weight are left out."""
    near = near_pairs(rooms, threshold).where(g.polygon_distance("a_points", "b_points") <= threshold)

    def edge(s: str, d: str) -> DataFrame:
        length = g.shared_boundary(f"{s}_points", f"{d}_points", F.lit(threshold / 2))
        return near.select(F.col(f"{s}_room").alias("src"), F.col(f"{d}_room").alias("dst"), length.alias("length"), g.perimeter(F.col(f"{s}_points")).alias("around"))

    weight = F.when(F.col("length") > min_shared, F.col("length") / F.col("around")).otherwise(min_weight)
    return edge("a", "b").unionByName(edge("b", "a")).select("src", "dst", weight.alias("weight")).where("weight > 0")


def vertical(rooms: DataFrame, weighted: bool = False, min_overlap: float = 0.05, min_weight: float = 0.0) -> DataFrame:
    """src, dst, weight of rooms on neighbouring floors whose outlines overlap by more than min_overlap; weighted: the
    overlap's share of src's area, and min_weight (if any) for all other rooms of neighbouring floors."""
    boxes, others = _by_shape(sides(rooms, "a"), sides(rooms, "b").withColumn("a_floor", F.col("b_floor") - 1).drop("b_floor"), 0.0)
    extent = lambda s: (F.col(f"{s}_box").x1 - F.col(f"{s}_box").x0) * (F.col(f"{s}_box").y1 - F.col(f"{s}_box").y0)
    whole = lambda s: g.area(F.col(f"{s}_points"))
    told = lambda df, overlap, area: df.select("a_room", "b_room", overlap.alias("overlap"), area("a").alias("a_area"), area("b").alias("b_area"))
    over = told(boxes, _box_overlap(), extent).unionByName(told(others, g.polygon_overlap("a_points", "b_points"), whole)).where(F.col("overlap") > min_overlap)
    weights = [F.col("overlap") / F.col(f"{s}_area") if weighted else F.lit(1.0) for s in ("a", "b")]
    found = over.select(_both(*weights))
    if not (weighted and min_weight > 0):
        return found
    # all other pairs, without their outlines: no overlap has to be computed of rooms whose boxes are apart
    at = lambda s: rooms.select(F.col("room_uri").alias(s), F.col("floor_number").alias(f"{s}_floor"))
    up = at("src").join(at("dst").withColumn("src_floor", F.col("dst_floor") - 1), "src_floor").select("src", "dst")
    pairs = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(float(min_weight))).alias("weight"))


def combined(*edges: DataFrame) -> DataFrame:
    """Weights of several edge frames added."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def outside(rooms: DataFrame, horizontal: DataFrame | None = None) -> DataFrame:
    """room_uri, weight to the outside: 1 with windows, else 0; with weighted horizontal edges what these leave of 1
    to rooms with windows, and 0 to others."""
    windows = F.coalesce(F.col("has_windows").cast("double"), F.lit(0.0))
    if horizontal is None:
        return rooms.select("room_uri", windows.alias("weight"))
    used = horizontal.groupBy(F.col("src").alias("room_uri")).agg(F.sum("weight").alias("used"))
    left = windows * F.greatest(F.lit(0.0), 1 - F.coalesce("used", F.lit(0.0)))
    return rooms.select("room_uri", "has_windows").join(used, "room_uri", "left").select("room_uri", left.alias("weight"))


def with_outside(edges: DataFrame, out: DataFrame) -> DataFrame:
    """Edges with those from a node `outside` to the rooms that have a weight to it."""
    return edges.unionByName(out.where("weight > 0").select(F.lit("outside").alias("src"), F.col("room_uri").alias("dst"), "weight"))


def propagation(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """room_uri, activation_step: 0 for seeds (rooms with devices); k + 1 for rooms with an edge from a room of step k
    that no earlier step reached. Rooms that nothing reaches (in so many rounds) are left out.

    Edges are written once, as each round reads them. A round expands the rooms of the last step only and drops those
    known by an anti-join.
    """
    edges = stash(edges.where("weight > 0").select("src", "dst").distinct(), "walked")
    front = stash(seeds.select("room_uri").distinct().withColumn("activation_step", F.lit(0)), "round")
    known = front
    for k in count(1):
        if rounds is not None and k > rounds:
            return known
        new = edges.join(front.select(F.col("room_uri").alias("src")), "src", "left_semi").select(F.col("dst").alias("room_uri")).distinct()
        front = stash(new.join(known, "room_uri", "left_anti").withColumn("activation_step", F.lit(k)), "round")
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def reached(rooms: DataFrame, seeds: DataFrame, rounds: int | None = None, threshold: float = 5.0, min_overlap: float = 0.05) -> DataFrame:
    """room_uri, activation_step as propagation gives them over the edges of horizontal_binary and vertical, without
    making these edges, of which there are as many as pairs of near rooms.

    A round looks for any room of the last step near each unknown one: a semi-join on floor and cell, which ends at the
    first one found.
    """
    size = max(4 * threshold, CELL)
    held = stash(sides(rooms, "a"), "outlines")
    only_boxes = held.where("not a_boxed").isEmpty()
    front = stash(seeds.select("room_uri").distinct().withColumn("activation_step", F.lit(0)), "round")
    known = front
    near = F.when(F.col("own"), _box_distance() <= threshold).otherwise(_box_overlap() > min_overlap)
    for k in count(1):
        if rounds is not None and k > rounds:
            return known
        left = held.join(known.select(F.col("room_uri").alias("a_room")), "a_room", "left_anti")
        at = held.join(front.select(F.col("room_uri").alias("a_room")), "a_room", "left_semi")
        at = at.select(*[F.col(c).alias(c.replace("a_", "b_", 1)) for c in at.columns], F.explode(F.array(*[F.lit(up) for up in (-1, 0, 1)])).alias("up"))
        at = at.select("b_room", "b_points", "b_box", "b_boxed", (F.col("b_floor") + F.col("up")).alias("a_floor"), (F.col("up") == 0).alias("own"))
        cells = ["a_floor", "cx", "cy"]
        boxes = _in_cells(left.where("a_boxed").drop("a_points"), "a", size, threshold).alias("a")
        fronts = _in_cells(at.where("b_boxed").select("a_floor", "b_box", "own"), "b", size, 0.0).select(*[F.col(c).alias(f"b_{c}") for c in cells], "b_box", "own")
        on = near
        for c in cells:
            on = (F.col(c) == F.col(f"b_{c}")) & on
        new = boxes.join(fronts.hint("merge"), on, "left_semi").select(F.col("a_room").alias("room_uri"))
        if not only_boxes:
            others = _met(left.where("not a_boxed"), at, size, threshold).unionByName(_met(left.where("a_boxed"), at.where("not b_boxed"), size, threshold))
            across = others.where(F.col("own")).where(g.polygon_distance("a_points", "b_points") <= threshold)
            up = others.where(~F.col("own") & _apart(0.0)).where(g.polygon_overlap("a_points", "b_points") > min_overlap)
            new = new.unionByName(across.unionByName(up).select(F.col("a_room").alias("room_uri")))
        front = stash(new.distinct().withColumn("activation_step", F.lit(k)), "round")
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def bundle(rooms: DataFrame, mode: str = "binary", kind: str = "combined", seeds: DataFrame | None = None, outside_node: bool = False) -> dict[str, DataFrame]:
    """All adjacency of rooms by mode (binary or weighted) and kind (horizontal, vertical or combined).

    edges: those of the kind, with the node `outside` among them if asked for; horizontal and vertical, if they are part
    of it; outside: weights to the outside; steps, with seeds: when a room is reached, over these edges (the outside, if
    a node, is there from the start).
    """
    if mode not in ("binary", "weighted") or kind not in ("horizontal", "vertical", "combined"):
        raise ValueError(f"unknown mode {mode} or kind {kind}")
    own = {}
    if kind != "vertical":
        own["horizontal"] = horizontal_weighted(rooms) if mode == "weighted" else horizontal_binary(rooms)
    if kind != "horizontal":
        own["vertical"] = vertical(rooms, weighted=mode == "weighted")
    edges = combined(*own.values())
    across = own.get("horizontal") if mode == "weighted" else None
    out = outside(rooms, across)
    if outside_node:
        edges = with_outside(edges, out)
    made = {**own, "outside": out, "edges": edges}
    if seeds is not None:
        start = seeds.select("room_uri")
        if outside_node:
            start = start.unionByName(seeds.sparkSession.createDataFrame([("outside",)], "room_uri string"))
        made["steps"] = propagation(edges, start)
    return made


def masked_edges(edges: DataFrame, steps: DataFrame, step: int) -> DataFrame:
    """The edges whose source may pass values on at a step."""
    ready = steps.where(F.col("activation_step") <= step).select(F.col("room_uri").alias("src"))
    return edges.join(ready, "src", "left_semi")


def by_kind(masked: DataFrame, horizontal: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masked edges split into those with a horizontal and those with a vertical edge."""
    keys = ["src", "dst"]
    return masked.join(horizontal.select(*keys), keys, "left_semi"), masked.join(up.select(*keys), keys, "left_semi")


def shift_operator(edges: DataFrame, kind: str, nodes: DataFrame | None = None) -> DataFrame:
    """Normalised edges of a graph of nodes (room_uri; by default those that have edges).

    rw divides weights by the number of src's edges, col by that of dst's, sym by the roots of both ends' sums of
    incoming weights; with the suffix _renorm every node has a loop of weight 1 first (for sym, if it has none). loops
    only adds the loops. _lap, of rw and sym, leaves loops out, divides by the sums of outgoing weights (src's, or the
    roots of both ends'), and takes the result from loops of weight 1.
    """
    base, *more = kind.split("_")
    e = edges.select("src", "dst", "weight")
    ends = e.select("src").unionByName(e.select(F.col("dst").alias("src"))).distinct() if nodes is None else nodes.select(F.col("room_uri").alias("src"))
    loops = ends.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    if base not in ("rw", "col", "sym", "loops") or base == "col" and "lap" in more:
        raise ValueError(f"unknown kind {kind}")
    if base == "loops":
        return combined(e, loops)
    if "lap" in more:
        e = e.where("src <> dst")
        d = e.groupBy(F.col("src").alias("n")).agg(F.sum("weight").alias("d"))
        return combined(loops, over_degrees(e, d, base).withColumn("weight", -F.col("weight")))
    if "renorm" in more:
        own = e.where("src = dst").select("src", "dst")
        e = combined(e, loops.join(own, ["src", "dst"], "left_anti") if base == "sym" else loops)
    if base == "sym":
        return over_degrees(e, e.groupBy(F.col("dst").alias("n")).agg(F.sum("weight").alias("d")), base)
    end = "src" if base == "rw" else "dst"
    degree = e.groupBy(end).agg(F.count("*").cast("double").alias("d"))
    return e.join(degree, end).select("src", "dst", (F.col("weight") / F.col("d")).alias("weight"))


def over_degrees(e: DataFrame, degrees: DataFrame, base: str) -> DataFrame:
    """Weights over src's degree, or over the roots of both ends' (n, d); without or with degree 0 the weight is 0."""
    side = lambda end: degrees.select(F.col("n").alias(end), F.col("d").alias(f"{end}_d"))
    both = e.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    part = lambda end: F.coalesce(1 / F.nullif(F.col(f"{end}_d"), F.lit(0.0)), F.lit(0.0))
    by = F.sqrt(part("src")) * F.sqrt(part("dst")) if base == "sym" else part("src")
    return both.select("src", "dst", (F.col("weight") * by).alias("weight"))


def spread(edges: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """Graph convolution without weights of its own: of each node and bucket the weighted sum over its in-edges.

    values: room_uri, bucket_idx and cols. A join on the source and a sum by target."""
    moved = edges.select("src", F.col("dst").alias("room_uri"), "weight").join(values.withColumnRenamed("room_uri", "src"), "src")
    return moved.groupBy("room_uri", "bucket_idx").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in cols])


def node_index(rooms: DataFrame) -> DataFrame:
    """room_uri and its dense number in the order of room numbers as texts (ties by uri)."""
    return dense_index(rooms.select("room_uri", "room_number"), ["room_number", "room_uri"], "node_idx").select("room_uri", "node_idx")


def normalised_areas(rooms: DataFrame) -> DataFrame:
    """room_uri, area, its min-max and its share over all floors (1 where all are equal; 0 without any area)."""
    a = rooms.select("room_uri", g.area(F.col("points")).alias("area"))
    t = a.agg(F.min("area").alias("lo"), F.max("area").alias("hi"), F.sum("area").alias("total"))
    return a.crossJoin(F.broadcast(t)).select("room_uri", "area", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("area") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("area_minmax"), F.when(F.col("total") <= 0, 0.0).otherwise(F.col("area") / F.nullif(F.col("total"), F.lit(0.0))).alias("area_share"))
