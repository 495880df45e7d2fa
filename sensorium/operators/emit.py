"""Triples made of tables: floor topology, geometries and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions import geometry as g
from sensorium.sources.triples import PREFIXES, RDF_TYPE, XSD

BLDG, EXO, GEOSPARQL, RDFS = (PREFIXES[k] for k in ("s4bldg", "ex-ont", "geosparql", "rdfs"))


def _t(s: Column, p: str, o: Column, literal: bool = False, dtype: str | None = None) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("literal" if literal else "iri").alias("o_kind"), F.lit(dtype).cast("string").alias("o_dtype"))


def topology(rooms: DataFrame, building: str = "urn:building") -> DataFrame:
    """Building, storey, space and outline triples of rooms (room_uri, floor_uri, floor_number, room_number, points)."""
    r, f, b = F.col("room_uri"), F.col("floor_uri"), F.lit(building)
    shape = F.concat(r, F.lit("/outline"))
    wkt = g.to_wkt(F.col("points"), F.col("floor_number"))
    each = F.array(
        _t(b, RDF_TYPE, F.lit(f"{BLDG}Building")), _t(f, RDF_TYPE, F.lit(f"{PREFIXES['bot']}Storey")), _t(b, f"{PREFIXES['bot']}hasStorey", f), _t(f, f"{BLDG}hasSpace", r),
        _t(r, RDF_TYPE, F.lit(f"{BLDG}BuildingSpace")), _t(r, f"{BLDG}isSpaceOf", f), _t(r, f"{RDFS}label", F.col("room_number"), True),
        _t(r, f"{EXO}hasDocumentGeometry", shape), _t(shape, f"{GEOSPARQL}asWKT", wkt, True, f"{GEOSPARQL}wktLiteral"),
    )
    return rooms.select(F.inline(each)).distinct()


def room_flags(rooms: DataFrame) -> DataFrame:
    """Triples of a room list (URI, isRoom)."""
    return rooms.select(F.inline(F.array(_t(F.col("URI"), f"{EXO}isProperRoom", F.col("isRoom"), True, f"{XSD}boolean"))))


def windows(windows: DataFrame) -> DataFrame:
    """Triples of windows (URI, direction, heading): the window, its room, heading and side."""
    w = F.concat("URI", F.lit("/window_"), "direction")
    each = F.array(_t(F.col("URI"), f"{EXO}hasWindow", w), _t(w, RDF_TYPE, F.lit(f"{EXO}Window")), _t(w, f"{EXO}hasFacingDirection", F.col("heading").cast("int"), True, f"{XSD}integer"), _t(w, f"{EXO}facingRelativeDirection", F.col("direction"), True))
    return windows.select(F.inline(each)).distinct()
