"""The library's inputs, made of the test tables: events are readings, users devices, nations rooms, regions floors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorium.operators import entities, levels
from sensorium.operators.calendar import Calendar, dutch_holidays, work_hours
from sensorium.sources.files import WEATHER
from sensorium.sources.triples import PREFIXES, RDF_TYPE

CALENDAR = Calendar(datetime(2024, 1, 1), datetime(2024, 1, 31), 360)
PROPERTIES = ["click", "error", "purchase", "signup", "view"]


def rounded(df: DataFrame) -> DataFrame:
    """Floats to eight digits (and no negative zero), as sums of floats depend on their order."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[(F.round(F.col(c).cast("double"), 8) + F.lit(0.0)).alias(c) if c in floats else c for c in df.columns])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("device_uri"), F.col("event_type").alias("property_uri"), F.col("ts").alias("timestamp"), "value")


def properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, p) for p in PROPERTIES], "property_uri string, property_type string")


def rooms(spark: SparkSession, sf: str) -> DataFrame:
    """room_uri, room_number, floor_number, points, has_windows: rectangles at scattered places of a plan of
    41 x 23, so that some of a floor are near each other, and some of neighbouring floors overlap."""
    k = F.col("n_nationkey")
    x, y = (k * 31 % 41).cast("double"), (k * 19 % 23).cast("double")
    w, h = (8 + k % 3).cast("double"), (7 + k % 4).cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    pts = F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))
    return table(spark, sf, "nation").select(F.concat(F.lit("room"), k.cast("string")).alias("room_uri"), F.col("n_name").alias("room_number"), F.col("n_regionkey").alias("floor_number"), pts.alias("points"), (k % 2 == 0).alias("has_windows"))


def l_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """rooms without the right half of their upper half: they are shaped like an L."""
    p = F.col("points")
    x, y, w, h = p[0].x, p[0].y, p[2].x - p[0].x, p[2].y - p[0].y
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    zero = F.lit(0.0)
    return rooms(spark, sf).withColumn("points", F.array(at(zero, zero), at(w, zero), at(w, h / 2), at(w / 2, h / 2), at(w / 2, h), at(zero, h)))


def many_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as rooms of as many floors as there are nations: small boxes at scattered places, more with the scale."""
    k = F.col("c_custkey")
    x, y = (k * 7919 % 997).cast("double"), (k * 7817 % 499).cast("double")
    w, h = (5 + k % 7).cast("double"), (4 + k % 5).cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    pts = F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))
    return table(spark, sf, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("room_uri"), F.col("c_nationkey").cast("int").alias("floor_number"), pts.alias("points"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly weather, out of the readings of each hour; hours without any have none."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date")
    e = table(spark, sf, "events").where("value is not null and not isnan(value)").groupBy(hour).agg(F.round(F.avg("value"), 6).alias("a"), F.max("value").alias("b"), F.min("value").alias("c"), F.count("*").alias("n"))
    of = {"temperature_2m": F.col("a"), "relative_humidity_2m": F.col("b"), "precipitation": F.col("c"), "wind_speed_10m": F.col("n") * 1.0, "wind_speed_80m": F.col("n") * 2.0, "cloud_cover": F.col("b") - F.col("c"), "wind_direction_10m": F.col("n") * 37.0 % 360, "wind_direction_80m": F.col("n") * 53.0 % 360, "weather_code": F.col("n") % 3 * 1.0}
    return e.select("date", *[of[c].cast("double").alias(c) for c in WEATHER])


def described_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """rooms with windows: one to the back if the number is even, a second one to the left if it is divisible by six."""
    k = F.substring("room_uri", 5, 9).cast("int")
    one, two = (k * 15 % 360).cast("double"), (k * 40 % 360).cast("double")
    headings = F.when(k % 6 == 0, F.array(one, two)).when(k % 2 == 0, F.array(one)).otherwise(F.array().cast("array<double>"))
    sides = F.when(k % 6 == 0, F.array(F.lit("Back"), F.lit("left"))).when(k % 2 == 0, F.array(F.lit("Back"))).otherwise(F.array().cast("array<string>"))
    return entities.window_features(rooms(spark, sf).withColumns({"headings": headings, "directions": sides, "is_proper_room": k % 3 == 0}))


def consumption(spark: SparkSession, sf: str) -> DataFrame:
    """bucket_idx, consumption: the sum of all readings of a bucket."""
    p = property_level(spark, sf)
    return p.groupBy(CALENDAR.bucket(F.col("timestamp")).alias("bucket_idx")).agg(F.sum("value").alias("consumption"))


def devices(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select("user_id").distinct()
    return d.select(F.col("user_id").cast("string").alias("device_uri"), F.concat(F.lit("room"), (F.col("user_id") % 25).cast("string")).alias("room_uri"))


def spine(spark: SparkSession) -> DataFrame:
    return CALENDAR.spine(spark)


def hours(spark: SparkSession) -> DataFrame:
    return work_hours(spine(spark), dutch_holidays([2024]))


def property_level(spark: SparkSession, sf: str) -> DataFrame:
    return levels.property_level(measurements(spark, sf), properties(spark), CALENDAR, PROPERTIES)


def device_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of device_level that have readings."""
    return levels.device_stats(property_level(spark, sf), CALENDAR)


def device_level(spark: SparkSession, sf: str) -> DataFrame:
    return levels.device_grid(device_stats(spark, sf), spine(spark))


def room_level(spark: SparkSession, sf: str, simple: bool = False) -> DataFrame:
    d = device_level(spark, sf)
    if simple:
        d = levels.clean_anomalies(d, period=24, offset=23)
    return levels.room_level(levels.with_rooms(d, devices(spark, sf), rooms(spark, sf)))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """room_uri, block_id, bucket_idx and the sum of clicks of each room and bucket with any readings of it."""
    p = property_level(spark, sf).where("property_type = 'click'").join(devices(spark, sf), "device_uri")
    b = CALENDAR.bucket(F.col("timestamp"))
    s = p.groupBy("room_uri", b.alias("bucket_idx")).agg(F.sum("value").alias("clicks"), F.avg("value").alias("mean"))
    return s.select("room_uri", CALENDAR.block(F.col("bucket_idx")).alias("block_id"), "bucket_idx", "clicks", "mean")


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as devices, nations as rooms and regions as floors, told in triples."""
    p = PREFIXES
    s = table(spark, sf, "supplier").select(F.concat(F.lit("urn:d"), F.col("s_suppkey").cast("string")).alias("s"), F.concat(F.lit("urn:roomname_"), F.col("s_nationkey").cast("string")).alias("room"), "s_name")
    n = table(spark, sf, "nation").select(F.concat(F.lit("urn:roomname_"), F.col("n_nationkey").cast("string")).alias("s"), F.concat(F.lit("urn:floor_"), F.col("n_regionkey").cast("string")).alias("floor"), "n_name", "n_nationkey")
    iri = lambda pr, o: F.struct(F.lit(pr).alias("p"), (F.lit(o) if o.startswith("http") else F.col(o)).alias("o"), F.lit("iri").alias("o_kind"))
    lit = lambda pr, o: F.struct(F.lit(pr).alias("p"), F.col(o).alias("o"), F.lit("literal").alias("o_kind"))
    dev = s.select("s", F.inline(F.array(iri(RDF_TYPE, f"{p['s4ener']}Device"), iri(f"{p['s4bldg']}isContainedIn", "room"), lit(f"{p['saref']}hasModel", "s_name"))))
    room = n.select("s", F.inline(F.array(iri(RDF_TYPE, f"{p['s4bldg']}BuildingSpace"), iri(f"{p['s4bldg']}isSpaceOf", "floor"))))
    label = n.where("n_nationkey % 3 = 0").select("s", F.inline(F.array(lit(f"{p['rdfs']}label", "n_name"))))
    zone = n.where("n_nationkey % 7 = 0").select("s", F.lit(f"{p['rdfs']}comment").alias("p"), F.lit("support_zone").alias("o"), F.lit("literal").alias("o_kind"))
    floor = n.select(F.col("floor").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(f"{p['s4bldg']}BuildingSpace").alias("o"), F.lit("iri").alias("o_kind"))
    contains = s.select(F.col("room").alias("s"), F.lit(f"{p['s4bldg']}contains").alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"))
    out = dev
    for x in (room, label, zone, floor, contains):
        out = out.unionByName(x)
    return out.withColumn("o_dtype", F.lit(None).cast("string")).distinct()
