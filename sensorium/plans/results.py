"""What an experiment reports: tidy metrics of forecasts, and scores of classifications, as frames of a few rows.

A forecast's rows are (horizon, y, p, source): all scopes, horizons, strategies, categories and bins come from grouped
aggregates over them; only the deviations by horizon, which the std strategy's borders are multiples of, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.operators import metrics
from sensorium.sources import sinks

#: Signs that labels of a category's bins begin with.
SIGNS = {"Overall": "", "Positive": "+", "Negative": "-"}


def bin_label(size: Column, borders: list[Column], names: list[str], category: Column) -> Column:
    """The label of a change's bin: `(low - high)`, or `(> low)` beyond the last border, with its category's sign."""
    out = F.lit(f"(> {names[-1]})")
    for border, low, high in reversed(list(zip(borders, names[:-1], names[1:], strict=True))):
        out = F.when(size < border, f"({low} - {high})").otherwise(out)
    sign = F.lit("")
    for name, s in SIGNS.items():
        sign = F.when(category == name, s).otherwise(sign)
    return F.concat(sign, out)


def binned(rows: DataFrame, borders: list[float]) -> DataFrame:
    """strategy (hardcoded or std), horizon, category, bin_label and metrics of the bins that have rows; a scope of one
    row has no std bins. rows: horizon (NULL: all), y, p, source; each scope has its own deviation."""
    delta = F.col("y") - F.col("source")
    spread = rows.groupBy("horizon").agg(F.stddev_pop(delta).alias("s"), F.count("*").alias("n")).select(F.col("horizon").alias("at"), F.when(F.col("n") > 1, F.col("s")).alias("s"))
    told = rows.join(F.broadcast(spread), rows["horizon"].eqNullSafe(F.col("at"))).select("horizon", "y", "p", "s", delta.alias("delta"), F.explode(metrics.categories(delta)).alias("category"))
    size, text = F.abs("delta"), [f"{b:g}" for b in (0.0, *borders)]
    stds = ["0.0std", *[f"{m:.1f}std" for m in metrics.STD_BINS]]
    hard = F.struct(F.lit("hardcoded").alias("strategy"), bin_label(size, [F.lit(b) for b in borders], text, F.col("category")).alias("bin_label"))
    std = F.when(F.col("s").isNotNull(), F.struct(F.lit("std").alias("strategy"), bin_label(size, [F.lit(m) * F.col("s") for m in metrics.STD_BINS], stds, F.col("category")).alias("bin_label")))
    both = told.select("horizon", "y", "p", "category", F.inline(F.array_compact(F.array(hard, std))))
    return both.groupBy("strategy", "horizon", "category", "bin_label").agg(*metrics.regression())


def forecast_report(rows: DataFrame, borders: list[float] | None = None) -> DataFrame:
    """The tidy report (columns of sinks.REPORT) of forecasts (horizon, y, p, source): overall, by horizon and, with
    borders, binned by the change from the source, over all horizons (horizon NULL) and each."""
    plain = metrics.overall_and_by(rows.select("horizon", "y", "p"), "horizon")
    parts = {"overall": plain.where("horizon is null"), "per_horizon": plain.where("horizon is not null")}
    if borders is not None:
        scoped = rows.select(F.explode(F.array(F.col("horizon"), F.lit(None))).alias("horizon"), "y", "p", "source")
        parts["binned"] = binned(scoped, borders)
    return sinks.metric_report(parts)


def classification_scores(rows: DataFrame, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """One row: confusion counts and scores at a threshold (by default the one with the best f1), roc_auc,
    average_precision, the majority's accuracy, and the improvement over it in percent. rows: y (0 or 1), p. strict is
    that of metrics.confusion and metrics.ranking."""
    if threshold is None:
        best = metrics.best_f1(rows).first()
        threshold = 0.5 if best is None or best.threshold is None else float(best.threshold)
    scores = sinks.classification_report(metrics.confusion(rows, threshold, strict)).withColumn("threshold", F.lit(threshold))
    gain = 100 * (F.col("accuracy") - F.col("majority_accuracy")) / F.nullif(F.col("majority_accuracy"), F.lit(0.0))
    return scores.withColumn("improvement", gain).crossJoin(F.broadcast(metrics.ranking(rows, strict)))


def report(task: str, rows: DataFrame, variable: str | None = None, threshold: float | None = None) -> DataFrame:
    """The report of a task: measurement_forecast (binned by the fixed borders of its variable, if it has any),
    consumption_forecast, or workhour_classification."""
    if task in ("measurement_forecast", "consumption_forecast"):
        return forecast_report(rows, metrics.DELTA_BINS.get(variable) if task == "measurement_forecast" else None)
    if task == "workhour_classification":
        return classification_scores(rows, threshold)
    raise ValueError(f"unknown task {task}")


def history(trials: DataFrame, minimise: bool = True) -> DataFrame:
    """study, trial, value and `best`: the best value of the study so far."""
    so_far = Window.partitionBy("study").orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.select("study", "trial", "value", (F.min if minimise else F.max)("value").over(so_far).alias("best"))


def champions(trials: DataFrame, minimise: bool = True) -> DataFrame:
    """The best trial of each study; of equal ones the first. Trials without a value are never best."""
    value = F.col("value") if minimise else -F.col("value")
    cols = [c for c in trials.columns if c != "study"]
    return trials.where("value is not null").groupBy("study").agg(F.min_by(F.struct(*cols), F.struct(value, F.col("trial"))).alias("x")).select("study", "x.*")
