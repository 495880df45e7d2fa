"""Polygons as arrays of points: closed forms as expressions, the rest as Arrow functions over pairs of rings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
#: Fixed value: pi as the shape statistics use it.
PI = 3.14159


def parse_wkt(wkt: Column) -> Column:
    """The outer ring of POLYGON or POLYGON Z as points, the closing point left out; NULL for other texts."""
    inner = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*Z?\s*\(\(([^()]*)\)", 1)
    raw = F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    pts = F.transform(raw, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    closed = (F.size(pts) > 1) & (F.element_at(pts, 1) == F.element_at(pts, -1))
    return F.when(inner != "", F.when(closed, F.slice(pts, 1, F.size(pts) - 1)).otherwise(pts))


def to_wkt(pts: Column, z: Column) -> Column:
    """POLYGON Z((x y z, ...)), closed."""
    ring = F.concat(pts, F.slice(pts, 1, 1))
    return F.concat(F.lit("POLYGON Z(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"), z.cast("string"))), ", "), F.lit("))"))


def translated(pts: Column, dx: float, dy: float) -> Column:
    return F.transform(pts, lambda p: F.struct((p.x + dx).alias("x"), (p.y + dy).alias("y")))


def _turned(pts: Column) -> Column:
    return F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def signed_area(pts: Column) -> Column:
    return _fold(F.zip_with(pts, _turned(pts), lambda a, b: a.x * b.y - b.x * a.y)) / 2


def area(pts: Column) -> Column:
    return F.abs(signed_area(pts))


def centroid(pts: Column, absolute: bool = False) -> Column:
    """Centre of mass; absolute=True divides by the area without its sign, which mirrors clockwise rings."""
    by = 6 * (area(pts) if absolute else signed_area(pts))
    cross = lambda a, b: a.x * b.y - b.x * a.y
    part = lambda c: _fold(F.zip_with(pts, _turned(pts), lambda a, b: (a[c] + b[c]) * cross(a, b))) / F.nullif(by, F.lit(0.0))
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def perimeter(pts: Column) -> Column:
    return _fold(F.zip_with(pts, _turned(pts), lambda a, b: F.hypot(a.x - b.x, a.y - b.y)))


def bounds(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def is_box(pts: Column) -> Column:
    """Whether a ring is the outline of its bounds: four corners, of which each and the next have one coordinate in common."""
    c = [F.get(pts, F.lit(k)) for k in range(4)]
    same = lambda axis, k: c[k][axis] == c[(k + 1) % 4][axis]
    turns = lambda a, b: same(a, 0) & same(b, 1) & same(a, 2) & same(b, 3)
    return F.coalesce((F.size(pts) == 4) & (turns("x", "y") | turns("y", "x")), F.lit(False))


def shape(pts: Column) -> Column:
    """area, perimeter, width, height, compactness, rect_fit, aspect_ratio."""
    b, a, p = bounds(pts), area(pts), perimeter(pts)
    w, h = b.x1 - b.x0, b.y1 - b.y0
    ratio = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0.0)), F.lit(0.0))
    return F.struct(a.alias("area"), p.alias("perimeter"), w.alias("width"), h.alias("height"), ratio(4 * PI * a, p * p).alias("compactness"), ratio(a, w * h).alias("rect_fit"), ratio(w, h).alias("aspect_ratio"))


def ring(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def inside(ps: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Which points lie in a ring, by crossings."""
    a, b = r, np.roll(r, -1, 0)
    x, y = ps[:, :1], ps[:, 1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return (np.sum(cross & (x < at), axis=1) % 2).astype(bool)


def _segment_distances(ps: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Least distance of each point from the ring's edges."""
    a, d = r, np.roll(r, -1, 0) - r
    rel = ps[:, None, :] - a[None]
    t = np.clip((rel * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    return np.hypot(*np.moveaxis(rel - t[..., None] * d, -1, 0)).min(1)


def _cross(r: np.ndarray, s: np.ndarray) -> bool:
    """Whether edges of the rings properly cross."""
    a, b, c, d = r[:, None], np.roll(r, -1, 0)[:, None], s[None], np.roll(s, -1, 0)[None]
    side = lambda p, q, x: (q[..., 0] - p[..., 0]) * (x[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (x[..., 0] - p[..., 0])
    return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any())


def ring_distance(r: np.ndarray, s: np.ndarray) -> float:
    if _cross(r, s) or inside(r[:1], s)[0] or inside(s[:1], r)[0]:
        return 0.0
    return float(min(_segment_distances(r, s).min(), _segment_distances(s, r).min()))


def overlap_area(r: np.ndarray, s: np.ndarray) -> float:
    """Area of the intersection of two simple rings: slabs between all vertices and crossings, exact trapezia in each."""
    edges = [(np.stack([q, np.roll(q, -1, 0)], 1)) for q in (r, s)]
    ys = set(r[:, 1]) | set(s[:, 1])
    for p in edges[0]:
        for q in edges[1]:
            d1, d2 = p[1] - p[0], q[1] - q[0]
            den = d1[0] * d2[1] - d1[1] * d2[0]
            if den:
                t = ((q[0] - p[0])[0] * d2[1] - (q[0] - p[0])[1] * d2[0]) / den
                u = ((q[0] - p[0])[0] * d1[1] - (q[0] - p[0])[1] * d1[0]) / den
                if 0 <= t <= 1 and 0 <= u <= 1:
                    ys.add(p[0][1] + t * d1[1])
    ys = sorted(ys)

    def spans(e: np.ndarray, y: float) -> list[tuple[float, float]]:
        on = e[(e[:, 0, 1] > y) != (e[:, 1, 1] > y)]
        xs = np.sort(on[:, 0, 0] + (y - on[:, 0, 1]) * (on[:, 1, 0] - on[:, 0, 0]) / (on[:, 1, 1] - on[:, 0, 1]))
        return list(zip(xs[::2], xs[1::2], strict=False))

    total = 0.0
    for y0, y1 in zip(ys, ys[1:], strict=False):
        mid = (y0 + y1) / 2  # within a slab the width is linear, so that its middle gives the area
        total += (y1 - y0) * sum(max(0.0, min(b, d) - max(a, c)) for a, b in spans(edges[0], mid) for c, d in spans(edges[1], mid))
    return total


def near_length(r: np.ndarray, s: np.ndarray, reach: float) -> float:
    """Length of r's boundary within reach of s's boundary: the union of each edge's parts near each edge of s."""
    total = 0.0
    for a, b in zip(r, np.roll(r, -1, 0), strict=True):
        d = b - a
        length = math.hypot(*d)
        if not length:
            continue
        parts = []
        for p, q in zip(s, np.roll(s, -1, 0), strict=True):
            parts += _near_parts(a, d / length, length, p, q, reach)
        upto = 0.0
        for x, y in sorted(parts):
            total += max(0.0, y - max(x, upto))
            upto = max(upto, y)
    return total


def _near_parts(a: np.ndarray, u: np.ndarray, length: float, p: np.ndarray, q: np.ndarray, reach: float) -> list[tuple[float, float]]:
    """Parts of the line a + t u, 0 <= t <= length, within reach of a segment: two discs and a strip between them."""
    out = []
    for c in (p, q):
        t = float((c - a) @ u)
        h2 = reach**2 - float((c - a) @ (c - a)) + t * t
        if h2 > 0:
            out.append((t - math.sqrt(h2), t + math.sqrt(h2)))
    e = q - p
    m = math.hypot(*e)
    if m:
        e, n = e / m, np.array([-e[1], e[0]]) / m
        lo, hi = -math.inf, math.inf
        for start, slope, least, most in ((float((a - p) @ e), float(u @ e), 0.0, m), (float((a - p) @ n), float(u @ n), -reach, reach)):
            if abs(slope) < 1e-12:
                if not least <= start <= most:
                    lo, hi = 1.0, 0.0
            else:
                x, y = sorted(((least - start) / slope, (most - start) / slope))
                lo, hi = max(lo, x), min(hi, y)
        if lo < hi:
            out.append((lo, hi))
    return [(max(0.0, x), min(length, y)) for x, y in out if max(0.0, x) < min(length, y)]


@F.pandas_udf(T.DoubleType())
def polygon_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ring_distance(ring(x), ring(y)) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def polygon_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_area(ring(x), ring(y)) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def shared_boundary(a: pd.Series, b: pd.Series, reach: pd.Series) -> pd.Series:
    return pd.Series([near_length(ring(x), ring(y), d) for x, y, d in zip(a, b, reach, strict=True)], dtype=float)


def simplify_ring(r: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a line of which no dropped one is further than the tolerance from what stays (farthest point first)."""
    keep = np.zeros(len(r), bool)
    keep[[0, -1]] = True
    todo = [(0, len(r) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = r[i], r[j] - r[i]
        rel, n = r[i + 1 : j] - a, math.hypot(*d)
        far = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / n if n else np.hypot(*rel.T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return r[keep]


def boundary_points(r: np.ndarray, most: int = 20) -> np.ndarray:
    """At most so many points along the boundary: each edge is cut evenly into as many parts as the mean distance fits
    into it (one at least), and begins each part with a point. None for fewer than three corners."""
    if len(r) < 3:
        return r[:0]
    step = np.roll(r, -1, 0) - r
    length = np.hypot(*step.T)
    if not length.any():
        return r[:most]
    parts = np.maximum(1, (length / (length.sum() / most)).astype(int))
    edge = np.repeat(np.arange(len(r)), parts)
    t = (np.arange(len(edge)) - np.repeat(np.cumsum(parts) - parts, parts)) / parts[edge]
    return (r[edge] + t[:, None] * step[edge])[:most]


def _points_udf(fn):
    @F.pandas_udf(POINTS)
    def run(points: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in fn(ring(p), n)] for p, n in zip(points, size, strict=True)])

    return run


simplified = _points_udf(simplify_ring)
evenly_spaced = _points_udf(lambda r, n: boundary_points(r, int(n)))
