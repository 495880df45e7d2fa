"""Exact quantiles of many columns or groups at once, without a task that holds all values of one.

Values are counted first (so a value in a third of all rows is one row), then dealt by ranges of (group, value). The
ranges' counts tell which range holds which wanted rank; only these ranges are looked through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorium.session import stash


def long(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (double) of each value that isn't NULL or NaN."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*parts))).where("value is not null and not isnan(value)")


def quantiles(values: DataFrame, by: str, wanted: dict | list[float], value: str = "value") -> DataFrame:
    """by, p, quantile: of each group the wanted shares' values, interpolated between the two nearest ranks.

    wanted is a list of shares for all groups, or a dict of lists by group. Groups without values get no rows.
    """
    spark = values.sparkSession
    counted = values.groupBy(F.col(by).alias("by"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    dealt = stash(counted.repartitionByRange("by", "value").withColumn("part", F.spark_partition_id()), "quantile-ranges")
    # a row for each group in each range
    held = dealt.groupBy("by", "part").agg(F.sum("n").alias("size"))
    own = Window.partitionBy("by")
    before = F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = stash(held.select("by", "part", "size", before.alias("before"), F.sum("size").over(own).alias("total")), "quantile-counts")
    totals = held.where("before = 0").select("by", "total")
    if isinstance(wanted, dict):
        kind = dict(values.dtypes)[by]
        asked = spark.createDataFrame([(g, float(p)) for g, ps in wanted.items() for p in sorted(set(ps))], f"by {kind}, p double").join(totals, "by")
    else:
        asked = totals.crossJoin(F.broadcast(spark.createDataFrame([(float(p),) for p in sorted(set(wanted))], "p double")))
    place = F.col("p") * (F.col("total") - 1)
    asked = stash(asked.select("by", "p", place.alias("place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")), "quantile-ranks")
    # the wanted ranks of each range, counted from its first value
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))
    ranks = asked.select("by", "rank").distinct().join(held, "by").where(inside).groupBy("by", "part").agg(F.collect_set(F.col("rank") - F.col("before")).alias("ranks"), F.first("before").alias("before"))
    some = dealt.join(ranks, ["by", "part"])
    upto = F.sum("n").over(Window.partitionBy("by", "part").orderBy("value"))
    hits = some.withColumn("upto", upto).select("by", "value", "before", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("at"))
    found = hits.select("by", (F.col("before") + F.col("at")).alias("rank"), "value")
    both = asked.join(found, ["by", "rank"]).groupBy("by", "p", "place").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return both.select(F.col("by").alias(by), "p", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("quantile"))


def of_columns(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, dict[float, float]]:
    """The wanted quantiles of each column, by share: a few numbers, for the driver. Columns without values are left out."""
    out: dict[str, dict[float, float]] = {}
    if wanted:
        for r in quantiles(long(df, list(wanted)), "column", wanted).collect():
            out.setdefault(r["column"], {})[r.p] = r.quantile
    return out
