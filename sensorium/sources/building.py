"""A building's entities out of its files: floors' plans and enrichments, and the devices on those floors.

Under a folder: floor_{n}_polygons.ttl and floor_{n}_enrichment.ttl for each floor, devices_in_rooms.ttl, which says
where devices are (or another file, by parameter), and devices/*/*.ttl with devices and their readings. Any number of
floors is read at once; device files are parsed only if their first lines name a device on one of the floors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.functions import geometry as g
from sensorium.operators import entities, snapshots, windows
from sensorium.operators.ordered import numbered_within

from .files import load_snapshot, snapshot
from .triples import graph, read_devices_of, read_floors, read_if_there


def devices_on(places: DataFrame, topology: DataFrame, floors: list[str]) -> DataFrame:
    """The triples that place devices on floors (uris): of each floor those that are on no other one."""
    both = graph(places, topology)
    return reduce(DataFrame.unionByName, [entities.devices_on_floor(both, f) for f in floors]).distinct()


def read_triples(spark: SparkSession, folder: str, floors: list[int], places: str = "devices_in_rooms.ttl") -> DataFrame:
    """All triples of the floors, as a set."""
    topology = graph(read_floors(spark, folder, floors, "polygons"), read_floors(spark, folder, floors, "enrichment"))
    told = read_if_there(spark, f"{folder}/{places}")
    uris = [r.floor_uri for r in entities.floors(topology).collect()]  # as many as floors are asked for
    if not uris:
        return topology
    placed = devices_on(told, topology, uris)
    kind = F.lit("iri").alias("o_kind")
    devices = entities.resources_of(placed, f"{entities.S4BLDG}contains")
    return graph(topology, placed.select("s", "p", "o", kind, F.lit(None).cast("string").alias("o_dtype")), read_devices_of(spark, folder, devices))


def extracted(triples: DataFrame) -> dict[str, DataFrame]:
    """The entity frames of a building: floors, rooms (with outline, if any, and windows' features), devices,
    measurements, property_types (as a list of each type) and sequences (readings of a device and property in order)."""
    outline = entities.polygons(triples, document=True).select("room_uri", g.parse_wkt(F.col("wkt")).alias("points"))
    faced = entities.windows(triples)
    rooms = entities.rooms(triples).join(outline, "room_uri", "left").join(faced, "room_uri", "left")
    readings = entities.measurements(triples)
    types = entities.property_types(triples)
    typed = readings.join(types, "property_uri").select("device_uri", "property_type", "timestamp", "value").where("value is not null")
    return {
        "floors": entities.floors(triples),
        "rooms": rooms,
        "devices": entities.devices(triples),
        "measurements": readings,
        "property_types": numbered_items(types),
        "sequences": windows.sequences(typed),
    }


def numbered_items(types: DataFrame) -> DataFrame:
    """property_type, seq, property_uri: the properties of each type, numbered from 0 by uri."""
    return numbered_within(types.select("property_type", "property_uri").distinct(), ["property_type"], ["property_uri"], "seq").select("property_type", "seq", "property_uri")


def read_building(spark: SparkSession, folder: str, floors: list[int], places: str = "devices_in_rooms.ttl") -> dict[str, DataFrame]:
    return extracted(read_triples(spark, folder, floors, places))


def write_floors(spark: SparkSession, folder: str, floors: list[int], to: str) -> None:
    """A snapshot of each floor by itself: {to}/floor_{n}."""
    for n in floors:
        snapshot(read_building(spark, folder, [n]), f"{to}/floor_{n}")


def load_floors(spark: SparkSession, folder: str, floors: list[int]) -> dict[str, DataFrame]:
    """The snapshots of floors put together in this order."""
    return snapshots.merged([load_snapshot(spark, f"{folder}/floor_{n}", list(snapshots.COLLECTIONS)) for n in floors])


def metadata(frames: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each collection."""
    return entities.summary(**frames)
