"""Node and edge frames of homogeneous and heterogeneous room graphs; a snapshot is a filter on the bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import dense_index


def node_maps(rooms: DataFrame, devices: DataFrame, device_level: DataFrame) -> dict[str, DataFrame]:
    """Dense numbers of rooms, devices and property nodes (device, property); small dimensions."""
    props = device_level.select("device_uri", "property_type").distinct()
    return {
        "room": dense_index(rooms.select("room_uri", "room_number"), ["room_number", "room_uri"], "node_idx"),
        "device": dense_index(devices.join(props.select("device_uri").distinct(), "device_uri", "left_semi").select("device_uri", "room_uri"), ["device_uri"], "node_idx"),
        "property": dense_index(props, ["device_uri", "property_type"], "node_idx"),
    }


def static_edges(nodes: dict[str, DataFrame], rooms: DataFrame, edges: DataFrame, outside: DataFrame) -> DataFrame:
    """kind, src, dst, weight by node numbers: room-room, device-room, property-device, outside-room and time-all."""
    room = nodes["room"].select("room_uri", F.col("node_idx").alias("room_idx"))
    device = nodes["device"].select("device_uri", "room_uri", F.col("node_idx").alias("device_idx"))
    prop = nodes["property"].select("device_uri", F.col("node_idx").alias("property_idx"))
    s, d = room.select(F.col("room_uri").alias("src"), F.col("room_idx").alias("a")), room.select(F.col("room_uri").alias("dst"), F.col("room_idx").alias("b"))
    out = edges.join(s, "src").join(d, "dst").select(F.lit("room-room").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    one = F.lit(1.0).alias("weight")
    out = out.unionByName(device.join(room, "room_uri").select(F.lit("device-room").alias("kind"), F.col("device_idx").alias("src"), F.col("room_idx").alias("dst"), one))
    out = out.unionByName(prop.join(device, "device_uri").select(F.lit("property-device").alias("kind"), F.col("property_idx").alias("src"), F.col("device_idx").alias("dst"), one))
    out = out.unionByName(outside.where("weight > 0").join(room, "room_uri").select(F.lit("outside-room").alias("kind"), F.lit(0).alias("src"), F.col("room_idx").alias("dst"), "weight"))
    for name, df, idx in (("time-room", room, "room_idx"), ("time-device", device, "device_idx"), ("time-property", prop, "property_idx")):
        out = out.unionByName(df.select(F.lit(name).alias("kind"), F.lit(0).alias("src"), F.col(idx).alias("dst"), one))
    return out


def property_nodes(nodes: dict[str, DataFrame], device_level: DataFrame) -> DataFrame:
    """bucket_idx, node_idx, mean, has_measurement of every property node: one join for all buckets."""
    return device_level.join(nodes["property"], ["device_uri", "property_type"]).select("bucket_idx", "node_idx", "property_type", "mean", "has_measurement")


def outside_nodes(weather: DataFrame, spine: DataFrame) -> DataFrame:
    """The weather of every bucket, joined on the bucket (a missing hour stays NULL and shifts nothing)."""
    return spine.select("bucket_idx").join(weather, "bucket_idx", "left")


def counts(nodes: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """kind, n of nodes and edges."""
    out = edges.groupBy("kind").agg(F.count("*").alias("n"))
    for k, df in nodes.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n"))
    return out


def weather_as_node(rooms_by_bucket: DataFrame, weather: DataFrame) -> DataFrame:
    """Rows of a pseudo-room `outside` with the weather columns only; rooms have none of them."""
    return rooms_by_bucket.unionByName(weather.withColumn("room_uri", F.lit("outside")), allowMissingColumns=True)


def dense_rows(values: DataFrame, rooms: DataFrame, spine: DataFrame, cols: list[str]) -> DataFrame:
    """bucket_idx and an array of each room's values (in node order) for every bucket: what a trainer reads."""
    grid = spine.select("bucket_idx").crossJoin(F.broadcast(rooms.select("room_uri", "node_idx")))
    full = grid.join(values.select("room_uri", "bucket_idx", *cols), ["room_uri", "bucket_idx"], "left")
    row = F.struct("node_idx", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    return full.groupBy("bucket_idx").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.x).alias("rooms"))


def type_numbers(nodes: dict[str, DataFrame], properties: list[str]) -> dict[str, DataFrame]:
    """node_type, key and node_idx of the typed graph, each type numbered from 0: room, device, a type prop_{property}
    for each property (its nodes are devices), outside and time."""
    spark = nodes["room"].sparkSession
    one = lambda n: spark.createDataFrame([(n, n, 0)], "node_type string, key string, node_idx int")
    out = {
        "room": nodes["room"].select(F.lit("room").alias("node_type"), F.col("room_uri").alias("key"), "node_idx"),
        "device": nodes["device"].select(F.lit("device").alias("node_type"), F.col("device_uri").alias("key"), "node_idx"),
        "outside": one("outside"),
        "time": one("time"),
    }
    for p in properties:
        own = nodes["property"].where(F.col("property_type") == p).select(F.lit(f"prop_{p}").alias("node_type"), F.col("device_uri").alias("key"))
        out[f"prop_{p}"] = dense_index(own, ["key"], "node_idx")
    return out


def numbers(cols: list[str]) -> Column:
    """The columns as an array of doubles, in order."""
    return F.array(*[F.col(c).cast("double") for c in cols]).alias("x")


def static_nodes(typed: dict[str, DataFrame], rooms: DataFrame, cols: list[str]) -> DataFrame:
    """node_type, node_idx, x of nodes that don't change: rooms with static features (NULL where there are none), and
    devices, whose only one is their number, for embeddings."""
    room = typed["room"].join(rooms.select(F.col("room_uri").alias("key"), *cols), "key", "left").select("node_type", "node_idx", numbers(cols))
    return room.unionByName(typed["device"].select("node_type", "node_idx", numbers(["node_idx"])))


def temporal_nodes(typed: dict[str, DataFrame], spine: DataFrame, device_level: DataFrame, weather: DataFrame, time_features: DataFrame, cols: list[str], absent: dict[str, float] | None = None) -> DataFrame:
    """bucket_idx, node_type, node_idx, x of nodes that change, with a row for each node and bucket.

    Property nodes have cols of the device level, outside the weather's columns and time the time features'; what isn't
    known in a bucket is NULL (of property nodes, what absent says), so that all types are aligned on the same buckets
    and on their nodes' order. The device level may leave out buckets without readings.
    """
    buckets = F.broadcast(spine.select("bucket_idx"))
    props = [df for name, df in typed.items() if name.startswith("prop_")]
    out = None
    if props:
        types = [name.removeprefix("prop_") for name in typed if name.startswith("prop_")]
        nodes = reduce(DataFrame.unionByName, props)
        level = device_level.where(F.col("property_type").isin(types)).select(F.concat(F.lit("prop_"), "property_type").alias("node_type"), F.col("device_uri").alias("key"), "bucket_idx", *cols)
        numbered = level.join(nodes, ["node_type", "key"]).drop("key")  # before the grid, which then goes by numbers
        every = nodes.drop("key").crossJoin(buckets)
        filled = every.join(numbered, ["node_type", "node_idx", "bucket_idx"], "left")
        filled = filled.fillna(absent) if absent else filled
        out = filled.select("bucket_idx", "node_type", "node_idx", numbers(cols))
    for name, values in (("outside", weather), ("time", time_features)):
        own = [c for c in values.columns if c != "bucket_idx"]
        one = spine.select("bucket_idx").join(values, "bucket_idx", "left").select("bucket_idx", F.lit(name).alias("node_type"), F.lit(0).alias("node_idx"), numbers(own))
        out = one if out is None else out.unionByName(one)
    return out


def typed_edges(typed: dict[str, DataFrame], nodes: dict[str, DataFrame], horizontal: DataFrame, vertical: DataFrame, outside: DataFrame) -> DataFrame:
    """src_type, relation, dst_type, src, dst, weight of the typed graph, by the numbers within types. Between rooms and
    devices, and devices and their properties, there is an edge in either direction."""
    at = lambda n, to: typed[n].select(F.col("key").alias(f"{to}_key"), F.col("node_idx").alias(to))
    cols = ["src_type", "relation", "dst_type", "src", "dst", "weight"]

    def told(df: DataFrame, src: str, relation: str, dst: str) -> DataFrame:
        joined = df.join(at(src, "src"), "src_key").join(at(dst, "dst"), "dst_key")
        return joined.withColumns({"src_type": F.lit(src), "relation": F.lit(relation), "dst_type": F.lit(dst)}).select(*cols)

    def turned(df: DataFrame, relation: str) -> DataFrame:
        return df.select(F.col("dst_type").alias("src_type"), F.lit(relation).alias("relation"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    keyed = lambda df, s, d, w=F.lit(1.0): df.select(F.col(s).alias("src_key"), F.col(d).alias("dst_key"), w.alias("weight"))
    out = [told(keyed(e, "src", "dst", F.col("weight")), "room", f"adjacent_{name}", "room") for name, e in (("horizontal", horizontal), ("vertical", vertical))]
    held = told(keyed(nodes["device"], "room_uri", "device_uri"), "room", "contains", "device")
    out += [held, turned(held, "contained_in")]
    for name in (n for n in typed if n.startswith("prop_")):
        own = told(keyed(typed[name].withColumn("device_uri", F.col("key")), "device_uri", "key"), "device", name.replace("prop_", "measures_", 1), name)
        out += [own, turned(own, "measured_by")]
    out.append(told(outside.where("weight > 0").select(F.lit("outside").alias("src_key"), F.col("room_uri").alias("dst_key"), "weight"), "outside", "influences", "room"))
    for name, df in typed.items():
        if name != "time":
            out.append(told(df.select(F.lit("time").alias("src_key"), F.col("key").alias("dst_key"), F.lit(1.0).alias("weight")), "time", f"affects_{name}", name))
    return reduce(DataFrame.unionByName, out)


def export_bundle(rooms: DataFrame, static: DataFrame, devices: DataFrame, device_level: DataFrame, properties: list[str], spine: DataFrame, weather: DataFrame, time_features: DataFrame, horizontal: DataFrame, vertical: DataFrame, outside: DataFrame, cols: list[str] = ("mean", "has_measurement"), absent: dict[str, float] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """All that a trainer of the typed graph reads: frames, and settings (feature names, which are unique over property
    types, property types). sinks.write_metadata writes both, sinks.read_metadata reads them.

    Frames: mappings (node_type, key, node_idx), static and temporal nodes, edges. A snapshot is a filter of temporal
    on its bucket. Written by (node_type, bucket_idx) ranges they come out in the nodes' order.
    """
    nodes = node_maps(rooms, devices, device_level)
    typed = type_numbers(nodes, properties)
    own = [c for c in static.columns if c != "room_uri"]
    temporal = temporal_nodes(typed, spine, device_level, weather, time_features, list(cols), absent)
    frames = {
        "mappings": reduce(DataFrame.unionByName, typed.values()),
        "static": static_nodes(typed, static, own),
        "temporal": temporal.repartitionByRange("node_type", "bucket_idx", "node_idx").sortWithinPartitions("node_type", "bucket_idx", "node_idx"),
        "edges": typed_edges(typed, nodes, horizontal, vertical, outside),
    }
    names = {"room": own, "device": ["embedding_index"], "outside": [c for c in weather.columns if c != "bucket_idx"], "time": [c for c in time_features.columns if c != "bucket_idx"]}
    names |= {f"prop_{p}": [f"{p}_{c}" for c in cols] for p in properties}
    return frames, {"feature_names": names, "property_types": list(properties)}
