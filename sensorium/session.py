"""A session with the settings that the library is meant for."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "sensorium", master: str | None = None, **settings: str) -> SparkSession:
    """Wall-clock times stay as they are (UTC session zone); adaptive execution sizes and splits partitions."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**fixed, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sensorium_sent", False):
        return
    home = Path(__file__).resolve().parent
    place = tempfile.mkdtemp(prefix="sensorium-")  # on the driver, from where Spark serves the file
    with zipfile.ZipFile(f"{place}/sensorium.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(f"{place}/sensorium.zip")
    context._sensorium_sent = True


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share (spark.checkpoint.dir); where that is
    unset, a temporary folder in local mode, and ValueError on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="sensorium-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/sensorium-{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Deletes the tables that this application has written to the shared folder; frames that read them end there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder (in folders by columns, if any) and reads it back: cuts
    lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    if (held := _recorded.get()) is not None:
        held.append(out)
    return out


def stash_bucketed(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """As stash, but in buckets by a column: joins and sums by it (and others) on the table need no shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/{table}"
    df.write.bucketBy(buckets, by).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._stashed, out._table = path, table
    if (held := _recorded.get()) is not None:
        held.append(out)
    return out


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_recorded: ContextVar[list[DataFrame] | None] = ContextVar("recorded", default=None)


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The frames that stash returns meanwhile (in this thread), so that they can be deleted when nothing reads them."""
    held: list[DataFrame] = []
    token = _recorded.set(held)
    try:
        yield held
    finally:
        _recorded.reset(token)


def unstash(*frames: DataFrame) -> None:
    """Deletes the tables of frames that stash or stash_bucketed returned; whatever reads them must have been written
    before."""
    for df in frames:
        if table := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stashed)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
