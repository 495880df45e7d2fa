"""Lags, moving averages, forecast targets and history windows, all within blocks.

The windows of a frame share one partitioning (block and further keys), so that Spark sorts once for all of them.
Lags and leads count rows, not time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import numbered

#: Rows of a chunk whose frames run over blocks.
CHUNK = 1 << 16
IDS = {"bucket_idx", "block_id", "room_uri", "floor_number"}


def by_block(extra: list[str] = ()) -> WindowSpec:
    return Window.partitionBy("block_id", *extra).orderBy("bucket_idx")


def default_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are no ids and no features made of others."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in IDS and "_lag_" not in f.name and "_ma_" not in f.name]


def lags(df: DataFrame, ks: list[int], cols: list[str] | None = None, extra: list[str] = ()) -> DataFrame:
    """{col}_lag_{k}: the value k rows before within the block."""
    w = by_block(extra)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in cols or default_columns(df) for k in ks])


def moving_averages(df: DataFrame, windows: list[int], shift: int = 1, cols: list[str] | None = None, extra: list[str] = (), across_blocks: bool = False) -> DataFrame:
    """{col}_ma_{w}_sh{shift}: mean of the w values up to `shift` rows before, within the block, of as many as there are.

    across_blocks=True lets the frame of w rows run on over the borders of blocks in the order of (block, extra,
    bucket), as a rolling mean over a sorted table does. Rows are numbered by ranges and cut into chunks, each with the
    rows before it that its first frames need, so no task holds them all; no two rows may be equal in that order.
    """
    w = by_block(extra)
    cols = cols or default_columns(df)
    rows = df.select("*", *[F.lag(c, shift).over(w).alias(f"__{c}") for c in cols])
    made = lambda over: [F.avg(f"__{c}").over(over.rowsBetween(1 - n, 0)).alias(f"{c}_ma_{n}_sh{shift}") for c in cols for n in windows]
    if not across_blocks:
        return rows.select("*", *made(w)).drop(*[f"__{c}" for c in cols])
    reach = max(windows) - 1
    placed = numbered(rows.withColumn("__order", F.struct("block_id", *extra, "bucket_idx")), "__order", "__at")
    size = max(CHUNK, reach)
    own = F.floor(F.col("__at") / size)
    chunks = F.when(F.col("__at") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    over = Window.partitionBy("__chunk").orderBy("__at")
    halved = placed.withColumn("__chunk", F.explode(chunks)).select("*", *made(over))
    return halved.where(own == F.col("__chunk")).drop("__order", "__at", "__chunk", *[f"__{c}" for c in cols])


def targets(df: DataFrame, source: str, horizons: list[int], delta: bool = False, extra: list[str] = (), hours: DataFrame | None = None) -> DataFrame:
    """target_h_{h}: the source h rows ahead within the block (less the present one for delta), as float.

    With hours (bucket_idx, is_workhour) also mask_h_{h}: whether that row is in work hours, 0 if there is none.
    """
    w = by_block(extra)
    if hours is not None:
        df = df.drop("is_workhour").join(F.broadcast(hours), "bucket_idx", "left")
    ahead = lambda h: F.lead(source, h).over(w) - (F.col(source) if delta else F.lit(0.0))
    out = [ahead(h).cast("float").alias(f"target_h_{h}") for h in horizons]
    if hours is not None:
        out += [F.coalesce(F.lead("is_workhour", h).over(w), F.lit(0)).cast("float").alias(f"mask_h_{h}") for h in horizons]
    return df.select("*", *out)


def keep_masked(df: DataFrame) -> DataFrame:
    """Rows in which all mask_h_* hold."""
    masks = [F.col(c) > 0 for c in df.columns if c.startswith("mask_h_")]
    out = df
    for m in masks:
        out = out.where(m)
    return out


def drop_missing_targets(df: DataFrame) -> DataFrame:
    return df.na.drop("any", subset=[c for c in df.columns if c.startswith("target_h_")])


def drop_columns(df: DataFrame, parts: list[str]) -> DataFrame:
    """df without the columns whose name has one of the parts."""
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def redundant_lags(df: DataFrame, horizon: int, always_over: int = 8) -> DataFrame:
    """Of the lags only those up to the horizon and the long ones."""
    k = {c: int(c.rsplit("_lag_", 1)[1]) for c in df.columns if "_lag_" in c}
    return df.drop(*[c for c, n in k.items() if horizon < n <= always_over])


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs in a fixed order: neither ids, targets nor masks."""
    return sorted(c for c in df.columns if c not in IDS | {"start", "end"} and not c.startswith(("target_h_", "mask_h_")))


#: Which statistics get lags and averages, and which averages only.
LAGGED = ("_mean", "_max", "_min", "temperature_2m", "relative_humidity_2m")
AVERAGED = ("_std", "_n_active_devices", "_has_measurement", "_count", "_average_intra_device_variation", "precipitation", "wind", "cloud")


def tabular_features(df: DataFrame, ks: list[int] = (1, 2, 3, 4, 5, 6, 7, 8, 24, 48), windows: list[int] = (3, 6, 12, 24, 48), shift: int = 1, extra: list[str] = ()) -> DataFrame:
    """Lags of the core columns, and averages of the core and secondary ones, none of lags."""
    own = [c for c in default_columns(df)]
    core = [c for c in own if c.endswith(LAGGED)]
    more = [c for c in own if c not in core and any(p in c for p in AVERAGED)]
    return moving_averages(lags(df, list(ks), core, extra), list(windows), shift, core + more, extra)


def histories(df: DataFrame, cols: list[str], n: int, max_horizon: int, extra: list[str] = (), replicate: bool = False) -> DataFrame:
    """Samples: of each row of a block up to its length less max_horizon the last n rows (`history`, oldest first,
    padded in front with zeros or the block's first row) and `padded`, how many of them are padding."""
    w = by_block(extra)
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in cols])
    seen = df.select("*", (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(Window.partitionBy("block_id", *extra)).alias("len"), F.collect_list(row).over(w.rowsBetween(1 - n, 0)).alias("seen"), F.first(row).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in cols])
    pad = F.array_repeat(F.col("first") if replicate else zero, (n - F.size("seen")).cast("int"))
    kept = seen.where(F.col("pos") <= F.col("len") - max_horizon)
    return kept.select("block_id", *extra, "bucket_idx", "pos", F.concat(pad, "seen").alias("history"), (n - F.size("seen")).alias("padded"))


def consecutive_gaps(rows: DataFrame) -> DataFrame:
    """Average time between readings of a device and property, then of a property, in seconds."""
    w = Window.partitionBy("device_uri", "property_type").orderBy("timestamp")
    gap = F.timestamp_diff("SECOND", F.lag("timestamp").over(w), F.col("timestamp"))
    per = rows.select("device_uri", "property_type", gap.alias("gap")).groupBy("device_uri", "property_type").agg(F.avg("gap").alias("gap"))
    return per.groupBy("property_type").agg(F.avg("gap").alias("avg_gap_s"))


def sequences(rows: DataFrame) -> DataFrame:
    """Of each device and property the readings in order of time, numbered."""
    w = Window.partitionBy("device_uri", "property_type").orderBy("timestamp", "value")
    return rows.withColumn("seq", F.row_number().over(w))


def masks_from(df: DataFrame, cols: list[str], workhour: Column | None = None) -> DataFrame:
    """{col}_mask: 1 where the column has a value (in work hours), else 0."""
    on = F.lit(1.0) if workhour is None else workhour.cast("double")
    return df.select("*", *[(F.col(c).isNotNull().cast("double") * on).alias(f"{c}_mask") for c in cols])


def fixed_samples(df: DataFrame, col: str, n_his: int, n_pred: int, extra: list[str] = ()) -> DataFrame:
    """Windows over a whole series: the n_his values that end at a row, and the value n_pred rows after it."""
    w = Window.partitionBy(*extra).orderBy("bucket_idx")
    x = F.collect_list(F.col(col)).over(w.rowsBetween(1 - n_his, 0))
    rows = df.select(*extra, "bucket_idx", x.alias("x"), F.lead(col, n_pred).over(w).alias("y"), F.row_number().over(w).alias("pos"), F.lead(F.lit(1), n_pred).over(w).alias("ahead"))
    return rows.where((F.col("pos") >= n_his) & F.col("ahead").isNotNull()).select(*extra, "bucket_idx", "x", "y")
