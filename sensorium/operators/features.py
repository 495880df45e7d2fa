"""Feature frames put together: static room features, series by bucket, consumption's own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.functions import geometry
from . import windows
from .adjacency import normalised_areas

#: The room attributes of each preset, in order.
PRESETS = {
    "minimal": ["is_proper_room", "area_minmax"],
    "standard": ["has_windows", "has_multiple_windows", "direction_sin", "direction_cos", "is_proper_room", "area_minmax"],
    "all": [
        "has_windows", "has_multiple_windows", "direction_sin", "direction_cos", "has_back_windows", "has_front_windows", "has_right_windows", "has_left_windows",
        "is_proper_room", "area_minmax", "area_share", "width", "height", "compactness", "rect_fit", "aspect_ratio", "perimeter",
    ],
}


def static_features(rooms: DataFrame, preset: str | list[str] = "standard") -> DataFrame:
    """room_uri and the preset's attributes (or those named) as doubles, NULL where a room has none or it is no number.

    Attributes are columns of rooms, areas over all rooms (area_minmax, area_share), or measures of the outline.
    """
    names = PRESETS[preset] if isinstance(preset, str) else preset
    shape = geometry.shape(F.col("points"))
    areas = normalised_areas(rooms).select("room_uri", *[F.col(c).alias(f"__{c}") for c in ("area_minmax", "area_share")])
    measures = ("area", "perimeter", "width", "height", "compactness", "rect_fit", "aspect_ratio")
    kinds = dict(rooms.dtypes)

    def value(c: str) -> Column:
        if c in kinds:
            v = F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)
        else:
            v = F.col(f"__{c}") if c in ("area_minmax", "area_share") else shape[c] if c in measures else F.lit(None)
        return (v.try_cast("double") if kinds.get(c) == "string" else v.cast("double")).alias(c)

    return rooms.join(areas, "room_uri").select("room_uri", *[value(c) for c in names])


def with_static(df: DataFrame, static: DataFrame) -> DataFrame:
    """df with the static features of its rooms; rooms without any keep NULLs."""
    return df.join(static, "room_uri", "left")


def with_buckets(df: DataFrame, *series: DataFrame) -> DataFrame:
    """df with the columns of series by bucket_idx (weather, work hours, consumption), which have a row for a bucket."""
    for s in series:
        df = df.join(F.broadcast(s), "bucket_idx", "left")  # no more rows than the calendar has buckets
    return df


def consumption_features(df: DataFrame, consumption: DataFrame, lags: list[int], means: list[int], shift: int = 1, extra: list[str] = ()) -> DataFrame:
    """df with the consumption of its bucket, and its moving averages and lags within the block."""
    joined = with_buckets(df, consumption.select("bucket_idx", "consumption"))
    return windows.lags(windows.moving_averages(joined, means, shift, ["consumption"], extra), lags, ["consumption"], extra)


def first_by_bucket(df: DataFrame, cols: list[str], order: str | Column) -> DataFrame:
    """bucket_idx and of each column its first value that isn't NULL, by order: for targets that no room tells apart."""
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy("bucket_idx").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])
