"""Regression and classification metrics as aggregates; rows never leave the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running

#: Upper borders of the bins of absolute change for two properties, the last bin being open.
DELTA_BINS = {"CO2Level": [10.0, 100.0, 250.0], "Temperature": [0.5, 2.0, 5.0]}
#: The same as multiples of the deviation of all changes.
STD_BINS = [0.1, 1.0, 3.0]
STEADY = 1e-6


def regression(y: str = "y", p: str = "p") -> list[Column]:
    """n, mae, mape (percent, of rows with y not 0), mse, r2 and rmse as aggregate expressions: one pass."""
    a, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(p).cast("double")
    spread = F.var_pop(a) * F.count(a)
    mse = F.avg(e * e)
    return [
        F.count(a).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.coalesce(F.avg(F.when(a != 0, F.abs(e / F.nullif(a, F.lit(0.0))))) * 100, F.lit(0.0)).alias("mape"),
        mse.alias("mse"),
        F.when(spread > 0, 1 - F.sum(e * e) / spread).otherwise(F.when(F.sum(e * e) == 0, 1.0).otherwise(0.0)).alias("r2"),
        F.sqrt(mse).alias("rmse"),
    ]


def overall_and_by(df: DataFrame, key: str) -> DataFrame:
    """Metrics by key and over all rows (key NULL) in one rollup."""
    return df.rollup(key).agg(*regression())


def wape(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    e = F.abs(F.col(y) - F.col(p))
    return df.agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.sum(e) / F.sum(y)).alias("wmape"))


def masked_loss(df: DataFrame, absolute: bool = False) -> DataFrame:
    """Mean error of rows with mask 1; 0 if there is none."""
    e = F.col("y") - F.col("p")
    e = F.abs(e) if absolute else e * e
    return df.agg(F.coalesce(F.sum(F.when(F.col("mask") > 0, e * F.col("mask"))) / F.nullif(F.sum("mask"), F.lit(0.0)), F.lit(0.0)).alias("loss"))


def hard_bins(delta: Column, borders: list[float]) -> Column:
    out = F.lit(f">={borders[-1]:g}")
    for lo, hi in reversed(list(zip([0.0, *borders], borders, strict=False))):
        out = F.when(F.abs(delta) < hi, f"[{lo:g},{hi:g})").otherwise(out)
    return out


def categories(delta: Column) -> Column:
    """Overall, and Positive or Negative where the change is one."""
    return F.array_compact(F.array(F.lit("Overall"), F.when(delta > STEADY, "Positive").when(delta < -STEADY, "Negative")))


def binned(df: DataFrame, borders: list[float]) -> DataFrame:
    """Metrics by bins of the absolute change (y - source), for all rows and for rising and falling ones; empty bins
    give no row. Needs y, p and source."""
    delta = F.col("y") - F.col("source")
    rows = df.select("y", "p", hard_bins(delta, borders).alias("bin_label"), F.explode(categories(delta)).alias("category"))
    return rows.groupBy("category", "bin_label").agg(*regression())


def std_binned(df: DataFrame, multiples: list[float] = STD_BINS) -> DataFrame:
    """As binned, with borders at multiples of the population deviation of all changes; no rows for fewer than two."""
    spread = df.agg(F.stddev_pop(F.col("y") - F.col("source")).alias("__s"), F.count("*").alias("__n")).where("__n > 1").select("__s")
    delta, s = F.col("y") - F.col("source"), F.col("__s")
    label = F.lit(f">={multiples[-1]:g}std")
    for lo, hi in reversed(list(zip([0.0, *multiples], multiples, strict=False))):
        label = F.when(F.abs(delta) < hi * s, f"[{lo:g},{hi:g})std").otherwise(label)
    rows = df.crossJoin(F.broadcast(spread))  # one row
    rows = rows.select("y", "p", label.alias("bin_label"), F.explode(categories(delta)).alias("category"))
    return rows.groupBy("category", "bin_label").agg(*regression())


def confusion(df: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """tp, fp, fn, tn, accuracy, balanced accuracy, precision, recall and f1 of labels y and scores p.

    Scores that would be 0 / 0 are 0; strict: NaN, and NULL without any rows, as SQL has them."""
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    d = df.agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"))
    part = lambda a, b: F.when(b == 0, F.lit(float("nan") if strict else 0.0)).otherwise(a / F.nullif(b, F.lit(0)))
    known = lambda c: c if strict else F.coalesce(c, F.lit(0.0))
    of = lambda a, b: known(part(F.col(a), F.col(a) + F.col(b)))
    d = d.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": of("tp", "fp"), "recall": of("tp", "fn"), "specificity": of("tn", "fp")})
    return d.withColumns({"balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "f1": known(part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))})


def curve(df: DataFrame) -> DataFrame:
    """Cumulative true and false positives by distinct score, highest first. Scores are counted before they meet."""
    per = df.groupBy("p").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    return running(per, F.desc("p"), {"tp": F.col("pos"), "fp": F.col("neg")})


def ranking(df: DataFrame, strict: bool = False) -> DataFrame:
    """roc_auc and average_precision (0.5 each if there is one class only; strict: NaN where they are 0 / 0, which
    average_precision is without positives, and NULL without any rows)."""
    c = curve(df)
    total = df.agg(F.sum((F.col("y") == 1).cast("long")).alias("np"), F.sum((F.col("y") != 1).cast("long")).alias("nn"))
    rows = c.crossJoin(F.broadcast(total))  # one row
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    if strict:
        out = rows.agg(F.max("np").alias("np"), F.max("nn").alias("nn"), area.alias("area"), ap.alias("ap"))
        no_area, no_ap, other = (F.col("np") == 0) | (F.col("nn") == 0), F.col("np") == 0, F.lit(float("nan"))
    else:
        out = rows.groupBy("np", "nn").agg(area.alias("area"), ap.alias("ap"))
        no_area = no_ap = (F.col("np") == 0) | (F.col("nn") == 0)
        other = F.lit(0.5)
    return out.select(F.when(no_area, other).otherwise(F.col("area") / F.nullif(F.col("np") * F.col("nn"), F.lit(0))).alias("roc_auc"), F.when(no_ap, other).otherwise(F.col("ap") / F.nullif(F.col("np"), F.lit(0))).alias("average_precision"))


def best_f1(df: DataFrame) -> DataFrame:
    """The score threshold with the best f1 (the highest of equal ones), and that f1."""
    total = df.agg(F.sum((F.col("y") == 1).cast("long")).alias("np"))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("np"))
    rows = curve(df).crossJoin(F.broadcast(total)).select("p", f1.alias("f1"))
    return rows.agg(F.max(F.struct("f1", "p")).alias("x")).select(F.col("x.p").alias("threshold"), F.col("x.f1").alias("f1"))


def class_weight(df: DataFrame) -> DataFrame:
    return df.agg((F.sum((F.col("y") != 1).cast("long")) / F.nullif(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).alias("pos_weight"))


def persistence(df: DataFrame, target: str, source: str, delta: bool = True) -> DataFrame:
    """The forecast that nothing changes: y and p in absolute terms, with the source; rows without a target are left out."""
    y = F.col(target) + F.col(source) if delta else F.col(target)
    return df.where(F.col(target).isNotNull() & F.col(source).isNotNull()).select(y.cast("double").alias("y"), F.col(source).cast("double").alias("p"), F.col(source).cast("double").alias("source"))


def summary(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric over runs."""
    return runs.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def top_keep_ties(df: DataFrame, by: str, n: int = 30) -> DataFrame:
    """The rows with the n greatest values, and those equal to the last of them, with their rank (`place`, from 1).

    The n-th value comes from a bounded sort; only rows from it on are ranked. NULLs come after all values."""
    least = df.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by).alias("__least"), F.count("*").alias("__n"), F.count(by).alias("__known"))
    kept = (F.col(by) >= F.col("__least")) | (F.col(by).isNull() & (F.col("__known") < F.col("__n")))
    few = df.crossJoin(F.broadcast(least)).where(kept).drop("__least", "__n", "__known")
    return few.withColumn("place", F.rank().over(Window.orderBy(F.desc(by))))
