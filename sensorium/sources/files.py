"""Weather, consumption, room lists, floor plans, prepared data and results."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorium.functions.geometry import POINTS
from sensorium.operators.calendar import between
from sensorium.session import ship

WEATHER = ["temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "wind_speed_80m", "cloud_cover", "wind_direction_80m", "wind_direction_10m", "weather_code"]


def read_weather(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Hourly weather of start <= date < end. Zones are cut off: wall-clock times."""
    schema = "date string, " + ", ".join(f"{c} double" for c in WEATHER)
    rows = spark.read.csv(path, header=True, schema=schema)
    ts = F.to_timestamp_ntz(F.substring(F.regexp_replace("date", "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return rows.withColumn("date", ts).where(between(F.col("date"), start, end))


def local_time(utc: Column, zone: str = "Europe/Berlin") -> Column:
    """Wall-clock time in a zone of a time in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def weather_by_bucket(weather: DataFrame, spine: DataFrame, minutes: int, one_hot: bool = False) -> DataFrame:
    """The weather of each bucket's hour, wind directions as sine and cosine; buckets without weather are left out."""
    if minutes > 60:
        raise NotImplementedError("weather is hourly")
    out = spine.select("bucket_idx", F.date_trunc("hour", "start").cast("timestamp_ntz").alias("date")).join(F.broadcast(weather), "date").drop("date")
    for c in ("wind_direction_10m", "wind_direction_80m"):
        out = out.withColumns({f"{c}_sin": F.sin(F.radians(c)), f"{c}_cos": F.cos(F.radians(c))}).drop(c)
    if one_hot:
        codes = sorted(r[0] for r in weather.select("weather_code").distinct().na.drop().collect())  # at most 100 codes
        out = out.withColumns({f"wc_{int(k)}": (F.col("weather_code") == k).cast("int") for k in codes})
    return out.drop("weather_code")


def file_date(name: str) -> date:
    """The date of meetdata_YYYY_MM_DD.csv; ValueError for other names."""
    m = re.fullmatch(r"meetdata_(\d{4})_(\d{2})_(\d{2})\.csv", name.rsplit("/", 1)[-1])
    if not m:
        raise ValueError(f"no date in {name}")
    return date(*map(int, m.groups()))


def read_consumption(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """file_date, row, time, consumption of the day files from first to last (both inclusive); rows marked mv dropped."""
    rows = spark.read.option("pathGlobFilter", "meetdata_*.csv").text(path, wholetext=True)
    day = F.make_date(*[F.regexp_extract(F.col("_metadata.file_name"), r"meetdata_(\d{4})_(\d{2})_(\d{2})\.csv", k).try_cast("int") for k in (1, 2, 3)])
    lines = rows.select(day.alias("file_date"), "value").where(F.col("file_date").between(F.lit(first), F.lit(last)))
    lines = lines.select("file_date", F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where((F.col("row") > 0) & (F.trim("line") != ""))
    cells = F.split("line", ",")
    return lines.select("file_date", "row", F.trim(F.get(cells, F.lit(0))).alias("time"), F.trim(F.get(cells, F.lit(1))).alias("raw")).where("raw <> 'mv'").select("file_date", "row", "time", F.col("raw").try_cast("double").alias("consumption"))


def consumption_by_bucket(rows: DataFrame, spine: DataFrame, per_bucket: int, aligned: bool = False) -> DataFrame:
    """Mean consumption of each bucket, NULL where there is none.

    Readings of a day are taken in groups of per_bucket by position, a group having its last reading's time, so that
    a missing reading shifts those after it; aligned=True groups by the time of day instead. A group belongs to the
    bucket that starts on its day and ends at its time.
    """
    w = Window.partitionBy("file_date").orderBy("row")
    minutes = F.substring("time", 1, 2).try_cast("int") * 60 + F.substring("time", 4, 2).try_cast("int")
    minutes = F.when(minutes == 0, 1440).otherwise(minutes)  # readings are labelled by their end
    place = F.floor((minutes - 1) / (15 * per_bucket)) if aligned else F.floor((F.row_number().over(w) - 1) / per_bucket)
    groups = rows.withColumn("g", place).groupBy("file_date", "g").agg(F.avg("consumption").alias("consumption"), F.max_by("time", "row").alias("time"), F.max("row").alias("row"))
    keyed = groups.groupBy("file_date", "time").agg(F.max_by("consumption", "row").alias("consumption"))  # of repeated labels the last
    at = spine.select("bucket_idx", F.col("start").cast("date").alias("file_date"), F.date_format("end", "HH:mm").alias("time"))
    return at.join(keyed, ["file_date", "time"], "left").select("bucket_idx", F.col("consumption").cast("float").alias("consumption"))


def read_room_list(spark: SparkSession, path: str) -> DataFrame:
    """URI, isRoom, isFacing, room_number; ValueError if one of the first three is missing."""
    rows = spark.read.csv(path, header=True)
    if missing := {"URI", "isRoom", "isFacing"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    number = F.col("room_number") if "room_number" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.trim("URI").alias("URI"), (F.upper(F.trim("isRoom")) == "TRUE").alias("isRoom"), F.lower(F.trim("isFacing")).alias("isFacing"), number.alias("room_number"))


def windows_of(rooms: DataFrame, heading: float = 27.0) -> DataFrame:
    """URI, direction, heading of each window: front is the building's heading, right +90, back +180, left +270."""
    turn = F.create_map(*[F.lit(x) for k, v in {"front": 0.0, "right": 90.0, "back": 180.0, "left": 270.0}.items() for x in (k, v)])
    one = rooms.where("isRoom and isFacing <> 'none'").select("URI", F.explode(F.split("isFacing", r"\s*,\s*")).alias("direction"))
    return one.select("URI", "direction", ((F.lit(heading) + F.try_element_at(turn, F.col("direction"))) % 360).alias("heading")).where("heading is not null")


def read_svg(spark: SparkSession, path: str, label: str = "inkscape:label") -> DataFrame:
    """label and d of each labelled path of a floor plan (labels stay text)."""
    ship(spark)
    schema = f"`_{label}` string, _d string, _id string, _transform string"
    return spark.read.format("xml").schema(schema).option("rowTag", "path").load(path).select(F.col(f"_{label}").alias("label"), F.col("_d").alias("d"), F.col("_transform").alias("transform")).where("d is not null")


def path_points(d: str) -> list[dict[str, float]]:
    """Corner points of an SVG path of M, L, H, V and Z commands, absolute or relative; closing points are left out."""
    out: list[tuple[float, float]] = []
    x = y = 0.0
    first = None
    for cmd, body in re.findall(r"([mMlLhHvVzZ])([^mMlLhHvVzZ]*)", d or ""):
        nums = [float(n) for n in re.findall(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", body)]
        rel = cmd.islower()
        c = cmd.upper()
        if c == "Z":
            if first:
                x, y = first
            continue
        step = 2 if c in "ML" else 1
        for k in range(0, len(nums) - step + 1, step):
            if c in "ML":
                x, y = (x + nums[k], y + nums[k + 1]) if rel else (nums[k], nums[k + 1])
            elif c == "H":
                x = x + nums[k] if rel else nums[k]
            else:
                y = y + nums[k] if rel else nums[k]
            if c == "M" and k == 0:
                first = (x, y)
            out.append((x, y))
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return [{"x": a, "y": b} for a, b in out]


@F.pandas_udf(POINTS)
def svg_points(d: pd.Series) -> pd.Series:
    return d.map(path_points)


#: Names of an Inkscape drawing, the labels of outlines, and the layer of rooms by label or else by id.
SVG_NS, LABEL = "{http://www.w3.org/2000/svg}", "{http://www.inkscape.org/namespaces/inkscape}label"
OUTLINES, ROOM_LAYER, ROOM_LAYER_ID = ("building", "building_ground"), "rooms", "layer1"
PLAN = "file string, width double, height double, kind string, label string, points array<struct<x:double,y:double>>"


def _shift(element: ElementTree.Element) -> tuple[float, float]:
    m = re.search(r"translate\(([-\d.]+),([-\d.]+)\)", element.get("transform", ""))
    return (float(m[1]), float(m[2])) if m else (0.0, 0.0)


def floor_plan(text: str) -> tuple[float, float, list[tuple[str, str, list[dict[str, float]]]]]:
    """Width and height of a drawing (of its view box, else its own), and (kind, label, points) of its outlines and rooms.

    Translations are taken away from points: an outline's own, a room's and that of its layer together. Rooms are the
    labelled paths of the layer; a drawing without one has no rooms.
    """
    root = ElementTree.fromstring(text.encode())
    box = root.get("viewBox", "").split()
    width, height = (float(x) for x in (box[2:] if len(box) == 4 else (root.get(k, "0").replace("pt", "") for k in ("width", "height"))))
    moved = lambda path, x, y: [{"x": p["x"] - x, "y": p["y"] - y} for p in path_points(path.get("d", ""))]
    out = []
    for name in OUTLINES:
        path = next((e for e in root.iter(f"{SVG_NS}path") if e.get(LABEL) == name), None)
        if path is not None and path.get("d"):
            out.append((name, name, moved(path, *_shift(path))))
    layers = list(root.iter(f"{SVG_NS}g"))
    layer = next((e for e in layers if e.get(LABEL) == ROOM_LAYER), None)
    layer = next((e for e in layers if e.get("id") == ROOM_LAYER_ID), None) if layer is None else layer
    for path in layer.findall(f"{SVG_NS}path") if layer is not None else ():
        label, (x, y), (dx, dy) = path.get(LABEL, ""), _shift(layer), _shift(path)
        if label and label not in OUTLINES and path.get("d"):
            out.append(("room", label, moved(path, x + dx, y + dy)))
    return width, height, out


def read_floor_plans(spark: SparkSession, path: str) -> DataFrame:
    """file, width, height and kind (building, building_ground, room), label, points of each outline and room of the
    drawings, each parsed by one task; of a drawing without any, one row with NULLs."""
    ship(spark)
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text, file in zip(f["value"], f["file"], strict=True):
                width, height, parts = floor_plan(text)
                rows = [(file, width, height, *p) for p in parts] or [(file, width, height, None, None, None)]
                yield pd.DataFrame(rows, columns=["file", "width", "height", "kind", "label", "points"], dtype=object)

    return texts.mapInPandas(run, PLAN)


def ground_outlines(plans: DataFrame) -> DataFrame:
    """file, width, height, points of each drawing's ground outline, which it must have: else the job fails."""
    of = F.when(F.col("kind") == "building_ground", F.col("points"))
    one = plans.groupBy("file", "width", "height").agg(F.max_by("points", of.isNotNull()).alias("p"), F.max(of.isNotNull()).alias("has"))
    missing = F.raise_error(F.concat(F.lit("no ground outline in "), F.col("file"))).cast("array<struct<x:double,y:double>>")
    return one.select("file", "width", "height", F.when(F.coalesce("has", F.lit(False)), F.col("p")).otherwise(missing).alias("points"))


def snapshot(frames: dict[str, DataFrame], path: str) -> None:
    """Entity frames as Parquet, by floor where they have one."""
    for name, df in frames.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("floor_number") if "floor_number" in df.columns else w).parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str], floors: list[int] | None = None) -> dict[str, DataFrame]:
    """The frames, pruned to the floors."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{path}/{n}")
        out[n] = df.where(F.col("floor_number").isin(floors)) if floors and "floor_number" in df.columns else df
    return out


def last_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of frames; of rows with one key that of the last frame."""
    out = parts[0].withColumn("__load", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("__load", F.lit(k)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("__load"))
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__load")


def dataset_name(kind: str, interval: str | int, family: str = "graph", weather: str | None = None, task: str | None = None) -> str:
    """The fixed name of a prepared dataset. kind: metadata, dataframe or hetero_input; family: graph or tabular."""
    if kind == "hetero_input":
        return f"hetero_input_{interval}"
    #: Parts of names.
    suffix = {"feature": "Wfeat", "node": "Wnode"}
    tasks = {"consumption_forecast": "consumption", "measurement_forecast": "measurement"}
    graph = {"metadata": "metadata", "dataframe": "stgcn"}
    if kind == "dataframe" and family == "tabular" and task in tasks:
        return f"tabular_{tasks[task]}_{interval}"
    if kind in graph and (kind == "metadata" or family == "graph") and weather in suffix:
        return f"{graph[kind]}_{interval}_{suffix[weather]}"
    raise ValueError(f"no dataset of kind {kind}, family {family}, weather {weather}, task {task}")


def key_values(text: Column) -> Column:
    """`a=1,b=2` as a map; NULL for an empty text."""
    return F.when(F.trim(text) != "", F.map_from_entries(F.transform(F.split(text, ","), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))), F.trim(F.substring(x, F.instr(x, "=") + 1, 1 << 30))))))


def read_results(spark: SparkSession, folder: str, which: str = "test") -> DataFrame:
    """All experiments' results with the union of their columns, and the experiment's name."""
    paths = f"{folder}/experiment_*/results_{which}.csv"
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(experiment_[^/]*)/[^/]*$", 1)
    return spark.read.option("header", True).option("inferSchema", True).csv(paths).withColumn("experiment", name)
