"""Experiments: prepared features, splits by blocks, training on Spark ML, metrics by horizon."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorium.operators import metrics, scaling, splits, windows


def prepared(df: DataFrame, source: str, horizons: list[int], delta: bool = False, hours: DataFrame | None = None, extra: list[str] = (), drop_outside_hours: bool = False) -> DataFrame:
    """Targets added, rows without a target dropped, rows outside work hours dropped if asked for."""
    out = windows.drop_missing_targets(windows.targets(df, source, horizons, delta, list(extra), hours))
    return windows.keep_masked(out) if drop_outside_hours and hours is not None else out


def scaled(df: DataFrame, table: DataFrame, fold: int, kinds: dict[str, str]) -> DataFrame:
    """All rows scaled with parameters of the fold's training blocks."""
    return scaling.transform(df, scaling.fit(splits.part(df, table, fold, "train"), kinds))


def naive(df: DataFrame, source: str, horizons: list[int], delta: bool = True) -> DataFrame:
    """horizon and metrics of persistence, by horizon and over all (horizon NULL)."""
    out = None
    for h in horizons:
        one = metrics.persistence(df, f"target_h_{h}", source, delta).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return metrics.overall_and_by(out, "horizon")


def boosted(train: DataFrame, test: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, absolute: bool = False, seed: int = 1, validation: DataFrame | None = None, classify: bool = False, least_gain: float = 0.01):
    """A gradient-boosted forecaster on Spark ML: (model, test rows with y and p).

    With validation rows, rounds stop when the error on them falls by less than least_gain. classify: labels 0 and 1,
    p being the score of 1.
    """
    names = [f"__f{k}" for k in range(len(features))]
    cast = lambda d: d.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)], F.col(target).cast("double").alias("y"))
    a, b = cast(train), cast(test)
    fill = Imputer(inputCols=names, outputCols=names, strategy="mean").fit(a)
    join = VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="keep")
    fitted = join.transform(fill.transform(a))
    how = {"featuresCol": "__x", "labelCol": "y", "maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": seed}
    if validation is not None:
        held = join.transform(fill.transform(cast(validation))).select("__x", "y", F.lit(True).alias("__held"))
        fitted = fitted.select("__x", "y", F.lit(False).alias("__held")).unionByName(held)
        how |= {"validationIndicatorCol": "__held", "validationTol": least_gain}
    if classify:
        model = GBTClassifier(**how).fit(fitted)
    else:
        model = GBTRegressor(predictionCol="p", lossType="absolute" if absolute else "squared", **how).fit(fitted)
    got = model.transform(join.transform(fill.transform(b)))
    return model, got.select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("p") if classify else "p")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, classify: bool = False):
    return (GBTClassificationModel if classify else GBTRegressionModel).load(path)


def importance(model, features: list[str], spark) -> DataFrame:
    rows = [(c, float(w)) for c, w in zip(features, model.featureImportances.toArray(), strict=True)]
    return metrics.top_keep_ties(spark.createDataFrame(rows, "feature string, importance double"), "importance")
