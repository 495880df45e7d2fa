"""The aggregates behind reports and figures; what is drawn is small."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.session import ship, stash

from .ordered import running

#: Comfortable ranges by property.
OPTIMAL = {"Temperature": (21.0, 24.0), "Humidity": (40.0, 60.0), "CO2Level": (0.0, 800.0)}


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, missing (percent), most first: one pass."""
    parts = [F.struct(F.lit(c).alias("column"), (F.avg(F.col(c).isNull().cast("double")) * 100).alias("missing")) for c in df.columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x")).orderBy(F.desc("missing"), "column")


def property_summary(rows: DataFrame) -> DataFrame:
    """property_type, mean, std, count and percent of all rows."""
    per = rows.groupBy("property_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("count"))
    total = per.agg(F.sum("count").alias("total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("property_type", "mean", "std", "count", (100 * F.col("count") / F.col("total")).alias("percent"))


def share_in_range(rows: DataFrame, ranges: dict[str, tuple[float, float]] = OPTIMAL, other: tuple[float, float] | None = None) -> DataFrame:
    """property_type, percent of values within its range."""
    ok: Column = F.lit(None).cast("boolean") if other is None else F.col("value").between(*other)
    for p, (lo, hi) in ranges.items():
        ok = F.when(F.col("property_type") == p, F.col("value").between(lo, hi)).otherwise(ok)
    return rows.withColumn("ok", ok).where("ok is not null").groupBy("property_type").agg((F.avg(F.col("ok").cast("double")) * 100).alias("percent"))


def hourly_profile(rows: DataFrame, ts: str = "timestamp", value: str = "value") -> DataFrame:
    return rows.groupBy(F.month(ts).alias("month"), F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def missing_by_bucket(device: DataFrame) -> DataFrame:
    return device.groupBy("bucket_idx").agg((100 * (1 - F.avg("has_measurement"))).alias("missing"))


def histogram(rows: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, n: bins of equal width, the last one closed; values outside are left out."""
    at = F.least(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(col).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r of each pair of columns (Pearson), over the rows that have both: one pass for all pairs."""
    parts = []
    for a, b in combinations(cols, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("r")))
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """As correlations, of mean ranks. Ranks come from counts by value, and running totals over ranges of values."""
    df = stash(df.select(*cols), "ranked")  # the values that are ranked must be those that are joined
    out = df
    for c in cols:
        per = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
        ranks = running(per, c, {"__upto": F.col("__n")}).select(c, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(f"__rank_{c}"))
        out = out.join(ranks, c, "left")
    renamed = out.select(*[F.col(f"__rank_{c}").alias(c) for c in cols])
    return correlations(renamed, cols)


def strongest(pairs: DataFrame, n: int = 10, least: float = 0.0) -> DataFrame:
    return pairs.where(F.abs("r") > least).orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def welch(df: DataFrame, value: str, group: Column) -> DataFrame:
    """t, degrees of freedom and two-sided p of the difference of two groups' means: one row of sums, then closed form."""
    v = F.col(value)
    one = df.select(v.cast("double").alias("v"), group.alias("g")).where("v is not null and g is not null")
    s = one.agg(*[f(F.when(F.col("g") == k, F.col("v"))).alias(f"{n}{int(k)}") for k in (True, False) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))])
    a, b = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    t = (F.col("m1") - F.col("m0")) / F.sqrt(a + b)
    nu = (a + b) ** 2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    ship(df.sparkSession)
    p = F.udf(_two_sided, "double")  # one row
    return s.select(F.col("m1").alias("mean_in"), F.col("m0").alias("mean_out"), t.alias("t"), nu.alias("nu")).withColumn("p", p("t", "nu"))


def _two_sided(t: float | None, nu: float | None) -> float | None:
    """Chance of a larger |t|: the regularised incomplete beta function by its continued fraction (Lentz)."""
    if t is None or nu is None:
        return None
    x, a, b = nu / (nu + t * t), nu / 2, 0.5
    if x in (0.0, 1.0):
        return x
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return 1 - front * f if flip else front * f


def weekday_hours(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows whose bucket is in work hours."""
    return rows.join(F.broadcast(hours.where("is_workhour = 1").select("bucket_idx")), "bucket_idx", "left_semi")


def first_samples(rows: DataFrame, order: list[str], n: int = 150) -> DataFrame:
    """The first n rows in an order, numbered from 0: what a figure of forecasts shows."""
    few = rows.orderBy(*order).limit(n)
    return few.withColumn("sample", F.row_number().over(Window.orderBy(*order)) - 1)


def daily_rooms(rows: DataFrame, day, hours: list[int] = tuple(range(24))) -> DataFrame:
    """room_uri with the mean value of each hour of a day."""
    own = rows.where(F.col("timestamp").cast("date") == F.lit(day))
    return own.groupBy("room_uri").pivot("hour", list(hours)).agg(F.avg("value")) if "hour" in own.columns else own.withColumn("hour", F.hour("timestamp")).groupBy("room_uri").pivot("hour", list(hours)).agg(F.avg("value"))
