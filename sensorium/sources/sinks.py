"""Writers of results, splits, reports and triples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tidy metric report, in order.
REPORT = {"scope": "string", "horizon": "int", "strategy": "string", "category": "string", "bin_label": "string", "n": "long", "mae": "double", "mape": "double", "mse": "double", "r2": "double", "rmse": "double"}


def metric_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Metric frames of several scopes as one tidy frame; columns that a part lacks are NULL."""
    out = None
    for scope, df in parts.items():
        own = df.withColumn("scope", F.lit(scope))
        one = own.select(*[(F.col(c) if c in own.columns else F.lit(None)).cast(t).alias(c) for c, t in REPORT.items()])
        out = one if out is None else out.unionByName(one)
    return out.orderBy("scope", "horizon", "category", "bin_label")


def classification_report(counts: DataFrame) -> DataFrame:
    """Confusion counts and scores with the share that always naming the larger class would get."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.withColumn("majority_accuracy", F.greatest(F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")) / F.nullif(n, F.lit(0)))


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_splits(splits: DataFrame, path: str, seed: int) -> None:
    """The split table as JSON lines, one for each fold and role, with the seed."""
    rows = splits.groupBy("fold", "role").agg(F.array_sort(F.collect_list("block_id")).alias("blocks")).withColumn("seed", F.lit(seed))
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_level(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """A level table as Parquet."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)


def write_metadata(frames: dict[str, DataFrame], settings: dict, path: str) -> None:
    """Blocks, buckets, adjacency and other frames as Parquet under path, with the settings they were made with as JSON."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = df.sparkSession
    write_settings(spark, settings, f"{path}/settings")


def read_metadata(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    """The frames and settings that write_metadata wrote."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, read_settings(spark, f"{path}/settings")


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Arguments or best parameters as one JSON file."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    (one,) = spark.read.text(path, wholetext=True).collect()
    return json.loads(one.value)


def combine_experiments(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, std, runs over all experiments."""
    parts = [F.struct(F.lit(m).alias("metric"), F.avg(F.col(m).cast("double")).alias("mean"), F.stddev_samp(F.col(m).cast("double")).alias("std"), F.count(m).alias("runs")) for m in metrics]
    return runs.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def merge_trials(studies: list[DataFrame], minimise: bool = True) -> DataFrame:
    """Trials of several studies in one table, numbered by value, best first; the direction is the caller's."""
    from pyspark.sql import Window

    out = None
    for k, s in enumerate(studies):
        one = s.withColumn("study", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    order = F.asc_nulls_last("value") if minimise else F.desc_nulls_last("value")
    return out.withColumn("place", F.row_number().over(Window.orderBy(order, "study", "trial")))
