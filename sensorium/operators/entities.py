"""Entities from triples: pattern joins over one frame of (s, p, o)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.sources.triples import PREFIXES, RDF_TYPE

S4BLDG, SAREF, GEO, GEOSPARQL, EXO, RDFS = (PREFIXES[k] for k in ("s4bldg", "saref", "geo", "geosparql", "ex-ont", "rdfs"))
RDFS_LABEL, RDFS_COMMENT = f"{RDFS}label", f"{RDFS}comment"


def of(triples: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    """Subjects and objects of one predicate."""
    return triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def local_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/#]+)$", 1)


def after(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def one_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One value for each key, the least: where a key has several, the choice doesn't depend on their order."""
    return rows.groupBy(key).agg(F.min(value).alias(value))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def floors(triples: DataFrame, prefix: str = "") -> DataFrame:
    """floor_uri and floor_number of the floors that rooms are spaces of."""
    rows = of(triples, f"{S4BLDG}isSpaceOf", o="floor_uri").select("floor_uri").where(F.col("floor_uri").startswith(prefix)).distinct()
    return rows.withColumn("floor_number", after(F.col("floor_uri"), "floor_").try_cast("int"))


def rooms(triples: DataFrame) -> DataFrame:
    """room_uri, floor_uri, room_number, is_support_zone, altitude, is_proper_room and has_windows of building spaces
    on a floor that aren't floors themselves: one pass groups all of a room's predicates."""
    preds = {f"{S4BLDG}isSpaceOf": "floor_uri", RDFS_COMMENT: "comment", RDFS_LABEL: "label", f"{GEO}alt": "altitude", f"{EXO}isProperRoom": "proper"}
    named = lambda p, a: F.min(F.when(F.col("p") == p, F.col("o"))).alias(a)
    space = F.max((F.col("p") == RDF_TYPE) & (F.col("o") == f"{S4BLDG}BuildingSpace")).alias("space")
    wanted = triples.where(F.col("p").isin([*preds, RDF_TYPE, f"{EXO}hasWindow"]))
    flat = wanted.groupBy("s").agg(space, *[named(p, a) for p, a in preds.items()], F.max(F.col("p") == f"{EXO}hasWindow").alias("has_windows")).where("space and floor_uri is not null")
    flat = flat.join(flat.select(F.col("floor_uri").alias("s")).distinct(), "s", "left_anti")  # NOT EXISTS: no room's floor
    number = F.coalesce(F.col("label"), after(F.col("s"), "roomname_"))
    return flat.select(F.col("s").alias("room_uri"), "floor_uri", after(F.col("floor_uri"), "floor_").try_cast("int").alias("floor_number"), number.alias("room_number"), F.coalesce(F.col("comment") == "support_zone", F.lit(False)).alias("is_support_zone"), F.col("altitude").try_cast("double").alias("altitude"), F.col("proper").try_cast("boolean").alias("is_proper_room"), "has_windows")


def polygons(triples: DataFrame, document: bool = False) -> DataFrame:
    """room_uri, wkt: the path from a room over its geometry to its text."""
    start = of(triples, f"{EXO}hasDocumentGeometry" if document else f"{GEOSPARQL}hasGeometry", "room_uri", "g")
    return one_each(start.join(of(triples, f"{GEOSPARQL}asWKT", "g", "wkt"), "g"), "room_uri", "wkt")


def windows(triples: DataFrame) -> DataFrame:
    """room_uri, headings, directions, and their features, of every room; one without windows has empty lists."""
    w = of(triples, f"{EXO}hasWindow", "room_uri", "w").join(of(triples, f"{EXO}hasFacingDirection", "w", "heading"), "w").join(of(triples, f"{EXO}facingRelativeDirection", "w", "direction"), "w")
    lists = w.groupBy("room_uri").agg(F.array_sort(F.collect_list(F.struct(F.col("heading").try_cast("double").alias("heading"), "direction"))).alias("x"))
    flat = rooms(triples).select("room_uri").join(lists, "room_uri", "left")
    return window_features(flat.select("room_uri", F.coalesce("x.heading", F.array().cast("array<double>")).alias("headings"), F.coalesce("x.direction", F.array().cast("array<string>")).alias("directions")))


def window_features(rooms_with_lists: DataFrame) -> DataFrame:
    """Circular mean of the headings that are numbers as sine and cosine (3 digits, half to even; 0 and 0 without any),
    whether there are several, of different windows, and a flag for each side."""
    known = F.array_compact("headings")
    mean = lambda f: F.coalesce(F.bround(F.aggregate(F.transform(known, lambda h: f(F.radians(h))), F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(known), F.lit(0)), 3), F.lit(0.0))
    on = lambda side: F.exists("directions", lambda d: F.contains(F.lower(d), F.lit(side)))
    sides = {f"has_{s}_windows": on(s) for s in ("back", "front", "right", "left")}
    return rooms_with_lists.withColumns({"direction_sin": mean(F.sin), "direction_cos": mean(F.cos), "has_multiple_windows": F.size(known) > 1, **sides})


def devices(triples: DataFrame) -> DataFrame:
    """device_uri, room_uri, manufacturer, model, device_type; of several values the least."""
    preds = {f"{S4BLDG}isContainedIn": "room_uri", f"{SAREF}hasManufacturer": "manufacturer", f"{SAREF}hasModel": "model", f"{PREFIXES['ic']}hasDeviceType": "device_type"}
    named = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(a) for p, a in preds.items()]
    is_device = F.max((F.col("p") == RDF_TYPE) & (F.col("o") == f"{PREFIXES['s4ener']}Device")).alias("dev")
    rows = triples.where(F.col("p").isin([*preds, RDF_TYPE])).groupBy("s").agg(is_device, *named).where("dev")
    return rows.select(F.col("s").alias("device_uri"), *preds.values())


def measurements(triples: DataFrame) -> DataFrame:
    """meas_uri, device_uri, timestamp, value, unit, property_uri: one grouping of all of a measurement's predicates,
    then one join with the devices that made them."""
    preds = {f"{SAREF}hasTimestamp": "timestamp", f"{SAREF}hasValue": "value", f"{SAREF}isMeasuredIn": "unit", f"{SAREF}relatesToProperty": "property_uri"}
    flat = triples.where(F.col("p").isin(list(preds))).groupBy(F.col("s").alias("meas_uri")).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(a) for p, a in preds.items()]).where("timestamp is not null and value is not null")
    made = of(triples, f"{SAREF}makesMeasurement", "device_uri", "meas_uri")
    ts = F.to_timestamp_ntz(F.substring(F.regexp_replace("timestamp", "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return made.join(flat, "meas_uri").select("meas_uri", "device_uri", ts.alias("timestamp"), F.col("value").try_cast("double").alias("value"), "unit", "property_uri")


def property_types(triples: DataFrame, mark: str = "property_") -> DataFrame:
    """property_uri, property_type (local names of types) of subjects whose local name starts with the mark."""
    return of(triples, RDF_TYPE, "property_uri", "t").where(local_name(F.col("property_uri")).startswith(mark)).select("property_uri", local_name(F.col("t")).alias("property_type")).distinct()


def devices_on_floor(triples: DataFrame, floor_uri: str) -> DataFrame:
    """The triples that place devices in rooms of a floor (support zones left out) and in no room of another floor."""
    inside = of(triples, f"{S4BLDG}contains", "room", "device")
    on = of(triples, f"{S4BLDG}isSpaceOf", "room", "floor")
    comment = one_each(of(triples, RDFS_COMMENT, "room", "comment"), "room", "comment")
    placed = inside.join(on, "room").join(comment, "room", "left").where("comment is null or comment <> 'support_zone'")
    elsewhere = placed.where(F.col("floor") != floor_uri).select("device").distinct()
    here = placed.where(F.col("floor") == floor_uri).join(elsewhere, "device", "left_anti")
    t = lambda s, p, o: F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), (F.col(o) if not o.startswith("http") else F.lit(o)).alias("o"))
    five = F.array(t("device", RDF_TYPE, f"{PREFIXES['s4ener']}Device"), t("device", f"{S4BLDG}isContainedIn", "room"), t("room", f"{S4BLDG}contains", "device"), t("room", f"{S4BLDG}isSpaceOf", "floor"), t("room", RDF_TYPE, f"{S4BLDG}BuildingSpace"))
    return here.select(F.inline(five)).distinct()


def without_places(triples: DataFrame) -> DataFrame:
    """triples without types of building spaces and without what places devices and rooms."""
    places = [f"{S4BLDG}{x}" for x in ("contains", "isContainedIn", "isSpaceOf")]
    return triples.where(~(F.col("p").isin(places) | (F.col("p") == RDF_TYPE) & (F.col("o") == f"{S4BLDG}BuildingSpace")))


def resources_of(triples: DataFrame, p: str) -> DataFrame:
    """All subjects and objects of a predicate."""
    rows = of(triples, p)
    return rows.select(F.col("s").alias("uri")).unionByName(rows.select(F.col("o").alias("uri"))).distinct()


def summary(**frames: DataFrame) -> DataFrame:
    """name, rows of each frame."""
    out = None
    for n, df in frames.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def room_summaries(rooms: DataFrame, devices: DataFrame) -> DataFrame:
    """room_uri, room_number, floor_number and n_devices of every room."""
    held = devices.groupBy("room_uri").agg(F.countDistinct("device_uri").alias("n_devices"))
    return rooms.select("room_uri", "room_number", "floor_number").join(held, "room_uri", "left").withColumn("n_devices", F.coalesce("n_devices", F.lit(0)))


def floor_summaries(rooms: DataFrame, devices: DataFrame) -> DataFrame:
    """floor_number, n_rooms and n_devices of every floor that has rooms."""
    return room_summaries(rooms, devices).groupBy("floor_number").agg(F.count("*").alias("n_rooms"), F.sum("n_devices").alias("n_devices"))


def device_summaries(devices: DataFrame, readings: DataFrame) -> DataFrame:
    """device_uri, room_uri, n_measurements, n_properties, first and last (timestamps) of every device; 0 and NULL
    without readings."""
    made = readings.groupBy("device_uri").agg(F.count("*").alias("n_measurements"), F.countDistinct("property_type").alias("n_properties"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return devices.select("device_uri", "room_uri").join(made, "device_uri", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_measurements", "n_properties")})


def rounded_value(value: Column) -> Column:
    return F.round(value, 1)


def time_uri(base: str, ts: Column, by_day: bool = False) -> Column:
    """A URI for a time's hour or day."""
    return F.concat(F.lit(base), F.date_format(ts, "yyyy-MM-dd" if by_day else "yyyy-MM-dd_HH'0000'"))
