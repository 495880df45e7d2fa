"""Device statistics of a stream of readings: tumbling buckets with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def device_stats(readings: DataFrame, bucket: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """start, device_uri, property_type and statistics of each bucket. Readings later than the watermark are dropped;
    state is kept for open buckets only."""
    v = F.col("value")
    kept = readings.where(v.isNotNull()).withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    per = kept.groupBy(F.window("ts", bucket).alias("w"), "device_uri", "property_type").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("count"))
    return per.select(F.col("w.start").alias("start"), "device_uri", "property_type", "mean", "std", "max", "min", "count")


def write_levels(stats: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends closed buckets to Parquet files, exactly once."""
    return stats.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
