"""Measurements rolled up: device, room, floor and building levels, each in long form and pivoted at the edge.

Long frames have one row for a level's key, bucket and property. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import Calendar, between

ROOM_STATS = ["mean", "std", "average_intra_device_variation", "max", "min", "count", "n_active_devices", "has_measurement"]
SIMPLE_STATS = ["mean", "std", "max", "min", "n_active_devices", "has_measurement"]
FLOOR_STATS = ["mean", "std", "average_intra_room_variation", "max", "min", "count", "n_active_devices", "n_active_rooms", "has_measurement", "average_intra_device_variation"]
BUILDING_STATS = ["count", "n_active_devices", "n_active_rooms", "max", "min", "has_measurement", "n_active_floors", "mean", "std", "average_intra_device_variation", "average_intra_room_variation", "average_intra_floor_variation"]
#: Statistics that are 0, not NULL, where a level has nothing of a property.
COUNTS = {"count", "n_active_devices", "n_active_rooms", "n_active_floors"}


def property_level(measurements: DataFrame, properties: DataFrame, calendar: Calendar, keep: list[str]) -> DataFrame:
    """Readings within the calendar of the kept property types, without NULL or NaN values: the fact table.

    properties: (property_uri, property_type), a small dimension; a uri of several types counts as its least one.
    """
    one = properties.groupBy("property_uri").agg(F.min("property_type").alias("property_type")).where(F.col("property_type").isin(keep))
    rows = measurements.where(between(F.col("timestamp"), calendar.start, calendar.end) & F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.join(F.broadcast(one), "property_uri").select("timestamp", "device_uri", "property_type", F.col("value").cast("double").alias("value"))


def skipped(measurements: DataFrame, properties: DataFrame, calendar: Calendar, keep: list[str]) -> DataFrame:
    """reason, n: of readings that property_level leaves out, the first that holds of time (outside the calendar),
    property (of no type that is kept) and value (NULL or NaN); and kept. All four have a row. One pass."""
    one = properties.groupBy("property_uri").agg(F.min("property_type").alias("property_type")).where(F.col("property_type").isin(keep))
    told = measurements.join(F.broadcast(one), "property_uri", "left")
    lost = ~F.coalesce(between(F.col("timestamp"), calendar.start, calendar.end), F.lit(False))
    reason = F.when(lost, "time").when(F.col("property_type").isNull(), "property").when(F.col("value").isNull() | F.isnan("value"), "value").otherwise("kept")
    counts = [F.struct(F.lit(r).alias("reason"), F.count_if(reason == r).alias("n")) for r in ("time", "property", "value", "kept")]
    return told.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def in_timeframe(rows: DataFrame, start, end, device_uri: str | None = None) -> DataFrame:
    """Readings from start to end, both inclusive (of one device)."""
    out = rows.where(F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return out if device_uri is None else out.where(F.col("device_uri") == device_uri)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or ValueError if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


def device_stats(rows: DataFrame, calendar: Calendar, strict: bool = False) -> DataFrame:
    """Mean, sample std, max, min and count by device, property and bucket: one shuffle after partial aggregation."""
    v = F.col("value")
    placed = rows.select("device_uri", "property_type", "value", calendar.bucket(F.col("timestamp"), strict).alias("bucket_idx")).where("bucket_idx is not null")
    return placed.groupBy("device_uri", "property_type", "bucket_idx").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("count"))


def device_grid(stats: DataFrame, spine: DataFrame) -> DataFrame:
    """Every device, every property type, every bucket; count 0 and no measurement where there was none.

    The grid is made of dimensions (devices, types, buckets); only the left join with the statistics is shuffled.
    """
    keys = stats.select("device_uri").distinct().crossJoin(F.broadcast(stats.select("property_type").distinct()))
    grid = keys.crossJoin(F.broadcast(spine.select("bucket_idx")))
    full = grid.join(stats, ["device_uri", "property_type", "bucket_idx"], "left")
    count = F.coalesce("count", F.lit(0))
    std = F.when(count == 1, F.lit(0.0)).otherwise(F.col("std"))
    return full.withColumns({"count": count, "std": std, "has_measurement": (count > 0).cast("int")})


def clear_where(df: DataFrame, wrong: Column) -> DataFrame:
    """Statistics NULL, count 0 and no measurement where a predicate holds."""
    stats = {c: F.when(~wrong, F.col(c)) for c in ("mean", "std", "max", "min") if c in df.columns}
    zero = {c: F.when(wrong, F.lit(0)).otherwise(F.col(c)) for c in ("count", "has_measurement") if c in df.columns}
    return df.withColumns({**stats, **zero})


def clean_anomalies(device: DataFrame, period: int | None = 288, offset: int = 287, buckets: list[int] = (), clear_high_counts: bool = True) -> DataFrame:
    """Clears periodic dumps (bucket % period = offset) and listed buckets; then, if asked for, means of more than one
    reading, and drops std, max, min and count, which say nothing about single readings."""
    if period:
        device = clear_where(device, F.col("bucket_idx") % period == offset)
    if buckets:
        device = clear_where(device, F.col("bucket_idx").isin(list(buckets)))
    if clear_high_counts:
        many = F.col("count") > 1
        device = device.withColumns({"mean": F.when(~many, F.col("mean")), "has_measurement": F.when(many, 0).otherwise(F.col("has_measurement"))}).drop("std", "max", "min", "count")
    return device


def missing_share(device: DataFrame) -> DataFrame:
    """Of each device and property the share of buckets without a mean."""
    return device.groupBy("device_uri", "property_type").agg(F.avg(F.col("mean").isNull().cast("double")).alias("missing"))


def drop_high_missingness(device: DataFrame, threshold: float = 0.15) -> DataFrame:
    keep = missing_share(device).where(F.col("missing") <= threshold).select("device_uri", "property_type")
    return device.join(keep, ["device_uri", "property_type"], "left_semi")


def with_rooms(device: DataFrame, devices: DataFrame, rooms: DataFrame) -> DataFrame:
    """device with room_uri and floor_number. A device without a room, or a room without a floor, makes the job fail
    when it meets its first row: nothing has to be computed beforehand to know."""
    place = devices.select("device_uri", "room_uri").join(rooms.select("room_uri", "floor_number"), "room_uri", "left")
    found = device.join(place, "device_uri", "left")
    lost = F.raise_error(F.concat(F.lit("device without a room on a floor: "), F.col("device_uri"))).cast(dict(found.dtypes)["floor_number"])
    return found.withColumn("floor_number", F.coalesce("floor_number", lost))


def only_alone(std: str, n: str) -> Column:
    """Spread of a single member: 0 instead of NULL."""
    return F.when(F.col(std).isNull() & (F.col(n) == 1), 0.0).otherwise(F.col(std)).alias(std)


def room_level(device: DataFrame) -> DataFrame:
    """device (with room_uri and floor_number) by room, bucket and property; fewer statistics after high counts were cleared."""
    full = "count" in device.columns
    m = "max" if full else "mean"
    aggs = [F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"), F.max(m).alias("max"), F.min("min" if full else "mean").alias("min"), F.sum("has_measurement").alias("n_active_devices"), F.max("has_measurement").alias("has_measurement")]
    if full:
        aggs += [F.avg("std").alias("average_intra_device_variation"), F.sum("count").alias("count")]
    out = device.groupBy("room_uri", "floor_number", "bucket_idx", "property_type").agg(*aggs)
    return out.select("room_uri", "floor_number", "bucket_idx", "property_type", *[only_alone(c, "n_active_devices") if c == "std" else c for c in (ROOM_STATS if full else SIMPLE_STATS)])


def floor_level(room: DataFrame) -> DataFrame:
    """room level by floor, bucket and property."""
    full = "count" in room.columns
    aggs = [F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"), F.avg("std").alias("average_intra_room_variation"), F.max("max").alias("max"), F.min("min").alias("min"), F.sum("n_active_devices").alias("n_active_devices"), F.sum("has_measurement").alias("n_active_rooms"), F.max("has_measurement").alias("has_measurement")]
    if full:
        aggs += [F.sum("count").alias("count"), F.avg("average_intra_device_variation").alias("average_intra_device_variation")]
    out = room.groupBy("floor_number", "bucket_idx", "property_type").agg(*aggs)
    return out.select("floor_number", "bucket_idx", "property_type", *[only_alone(c, "n_active_rooms") if c == "std" else c for c in FLOOR_STATS if c in out.columns])


def building_level(floor: DataFrame) -> DataFrame:
    """floor level by bucket and property. Counts are 0 and variations NULL where the floors don't have them."""
    has = lambda c: c in floor.columns
    aggs = [
        (F.coalesce(F.sum("count"), F.lit(0)) if has("count") else F.lit(0)).cast("long").alias("count"),
        F.coalesce(F.sum("n_active_devices"), F.lit(0)).alias("n_active_devices"), F.coalesce(F.sum("n_active_rooms"), F.lit(0)).alias("n_active_rooms"),
        F.max("max").alias("max"), F.min("min").alias("min"), F.max("has_measurement").alias("has_measurement"), F.coalesce(F.sum("has_measurement"), F.lit(0)).alias("n_active_floors"),
        F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"),
        (F.avg("average_intra_device_variation") if has("average_intra_device_variation") else F.first(F.lit(None).cast("double"))).alias("average_intra_device_variation"),
        F.avg("average_intra_room_variation").alias("average_intra_room_variation"), F.avg("std").alias("average_intra_floor_variation"),
    ]
    out = floor.groupBy("bucket_idx", "property_type").agg(*aggs)
    return out.select("bucket_idx", "property_type", *[only_alone(c, "n_active_floors") if c == "std" else c for c in BUILDING_STATS])


def wide(level: DataFrame, keys: list[str], properties: list[str], prefix: str = "") -> DataFrame:
    """A level pivoted: {prefix}{property}_{statistic}; counts of absent properties are 0, all else NULL."""
    stats = [c for c in level.columns if c not in {*keys, "property_type", "room_uri", "floor_number", "bucket_idx"}]
    out = level.groupBy(*keys).pivot("property_type", properties).agg(*[F.first(c).alias(c) for c in stats])
    cols = [(F.coalesce(F.col(f"{p}_{s}"), F.lit(0)) if s in COUNTS else F.col(f"{p}_{s}")).alias(f"{prefix}{p}_{s}") for p in properties for s in stats]
    return out.select(*keys, *cols)


def floors_wide(floor: DataFrame, floors: list[int], properties: list[str]) -> DataFrame:
    """The floor level with one row for each bucket: F{floor}_{property}_{statistic}."""
    keyed = floor.withColumn("property_type", F.concat(F.lit("F"), F.col("floor_number").cast("string"), F.lit("_"), F.col("property_type"))).drop("floor_number")
    stats = [c for c in keyed.columns if c not in ("property_type", "bucket_idx")]
    names = [f"F{f}_{p}" for f in floors for p in properties]
    out = keyed.groupBy("bucket_idx").pivot("property_type", names).agg(*[F.first(c).alias(c) for c in stats])
    return out.select("bucket_idx", *[f"{n}_{s}" for n in names for s in stats])


def expanded(wide_rooms: DataFrame, rooms: DataFrame, spine: DataFrame) -> DataFrame:
    """All rooms and all buckets, with a room's values where it has any."""
    grid = rooms.select("room_uri").distinct().crossJoin(F.broadcast(spine.select("bucket_idx")))
    return grid.join(wide_rooms, ["room_uri", "bucket_idx"], "left")


def sparsity(device: DataFrame) -> DataFrame:
    """By property: pairs of device and bucket with no, one and several readings, without spread, and all readings."""
    c, n = F.col("count"), lambda x: F.sum(F.when(x, 1).otherwise(0))
    return device.groupBy("property_type").agg(n(c == 0).alias("none"), n(c == 1).alias("single"), n(c > 1).alias("several"), n(F.col("std") == 0).alias("no_spread"), n((F.col("mean") == F.col("min")) & (F.col("mean") == F.col("max"))).alias("all_equal"), F.sum(c).alias("readings"), F.countDistinct("device_uri").alias("devices"))
