"""Time buckets, weekly blocks, work hours, holidays and time features."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import numbered


@dataclass(frozen=True)
class Calendar:
    """Buckets of `minutes` from start (midnight) to end, without Sundays if asked for. Minutes must divide a day."""

    start: datetime
    end: datetime
    minutes: int = 30
    drop_sundays: bool = True

    def __post_init__(self):
        if 1440 % self.minutes or self.start.time() != datetime.min.time():
            raise ValueError("buckets must divide a day, and the calendar must start at midnight")

    @property
    def per_day(self) -> int:
        return 1440 // self.minutes

    @property
    def block_size(self) -> int:
        """Buckets in a block of a week: six or seven days."""
        return self.per_day * (6 if self.drop_sundays else 7)

    @property
    def size(self) -> int:
        """Number of buckets; only whole ones before the end."""
        whole = int((self.end - self.start) / timedelta(minutes=self.minutes))
        days, rest = divmod(whole, self.per_day)
        if not self.drop_sundays:
            return whole
        sunday = (self.start.weekday() + days) % 7 == 6
        return (days - (days + self.start.weekday()) // 7) * self.per_day + (0 if sunday else rest)

    def spine(self, spark: SparkSession) -> DataFrame:
        """bucket_idx, start, end, block_id of every bucket, by arithmetic on its number."""
        i, wd = F.col("id"), self.start.weekday() if self.drop_sundays else 0
        work = F.floor(i / self.per_day)
        first = 6 - wd  # work days before the first Sunday
        sundays = F.when(work < first, F.lit(0)).otherwise(F.floor((work - first) / 6) + 1) if self.drop_sundays else F.lit(0)
        minutes = (work + sundays) * 1440 + (i % self.per_day) * self.minutes
        start = F.lit(self.start).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))
        out = spark.range(self.size).select(i.cast("int").alias("bucket_idx"), start.alias("start"))
        return out.select("bucket_idx", "start", (F.col("start") + F.make_dt_interval(mins=F.lit(self.minutes))).alias("end"), self.block(F.col("bucket_idx")).alias("block_id"))

    def block(self, bucket: Column) -> Column:
        return F.floor(bucket / self.block_size).cast("int")

    def bucket(self, ts: Column, strict: bool = False) -> Column:
        """The bucket whose start is the last one at or before ts; NULL outside the calendar.

        Times in a dropped Sunday fall into Saturday's last bucket, since that is the last start before them;
        strict=True gives them NULL instead. Arithmetic on each row: no join, no shuffle.
        """
        zero = F.lit(self.start).cast("timestamp_ntz")
        seconds = F.timestamp_diff("SECOND", zero, ts)
        days, slot = F.floor(seconds / 86400), F.floor((seconds % 86400) / (60 * self.minutes))
        if self.drop_sundays:
            wd = self.start.weekday()
            work = days - F.floor((days + wd) / 7)
            sunday = (days + wd) % 7 == 6
            idx = F.when(sunday, F.lit(None) if strict else work * self.per_day - 1).otherwise(work * self.per_day + slot)
        else:
            idx = days * self.per_day + slot
        last = F.lit(self.start + timedelta(minutes=0)).cast("timestamp_ntz")
        inside = (ts >= last) & (ts < F.lit(self.end).cast("timestamp_ntz"))
        return F.when(inside & (idx >= 0) & (idx < self.size), idx.cast("int"))


def between(ts: Column, start: datetime, end: datetime) -> Column:
    """start <= ts < end, which reaches the scan."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def easter(year: int) -> date:
    """Western Easter Sunday, by the anonymous Gregorian rule."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    n = h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114
    return date(year, n // 31, n % 31 + 1)


def dutch_holidays(years: range | list[int]) -> dict[date, str]:
    """Public holidays in the Netherlands; the king's day moves to Saturday if it is a Sunday."""
    out = {}
    for y in years:
        e, king = easter(y), date(y, 4, 27)
        out |= {date(y, 1, 1): "New Year's Day", e - timedelta(2): "Good Friday", e: "Easter Sunday", e + timedelta(1): "Easter Monday"}
        out |= {king - timedelta(king.weekday() == 6): "King's Day", e + timedelta(39): "Ascension Day", e + timedelta(49): "Whit Sunday", e + timedelta(50): "Whit Monday"}
        out |= {date(y, 12, 25): "Christmas Day", date(y, 12, 26): "Second Day of Christmas"}
        if y >= 1990 and y % 5 == 0:
            out[date(y, 5, 5)] = "Liberation Day"
    return out


def work_hours(spine: DataFrame, holidays: list[date] | dict[date, str], first: int = 8, last: int = 18) -> DataFrame:
    """bucket_idx, is_workhour: Monday to Friday, no holiday, first <= hour < last."""
    start = F.col("start")
    days = sorted(holidays)
    free = start.cast("date").isin(days) if days else F.lit(False)
    return spine.select("bucket_idx", (~free & (F.weekday(start) < 5) & (F.hour(start) >= first) & (F.hour(start) < last)).cast("tinyint").alias("is_workhour"))


def time_features(spine: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Sine and cosine of hour (of 24), weekday (of 7) and ISO week (of 53), and is_workhour."""
    s = F.col("start")
    cols = []
    for name, x, n in (("hour", F.hour(s), 24), ("dow", F.weekday(s), 7), ("woy", F.weekofyear(s), 53)):
        angle = 2 * F.pi() * x / n
        cols += [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]
    out = spine.select("bucket_idx", *cols)
    return out.join(F.broadcast(hours), "bucket_idx", "left") if hours is not None else out


def strata(spine: DataFrame) -> DataFrame:
    """block_id and its numbers of buckets."""
    return spine.groupBy("block_id").agg(F.count("*").alias("n"), F.min("bucket_idx").alias("first"), F.max("bucket_idx").alias("last"))


def dense_index(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with a dense number from 0 in the order of some columns, in which no two rows are equal."""
    ordered = df.withColumn("__order", F.struct(*by))
    return numbered(ordered, "__order", name).drop("__order").withColumn(name, F.col(name).cast("int"))
