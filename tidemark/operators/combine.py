"""Forecast combinations over (instrument, day, model, split, y, y_pred)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def on_common_days(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the days on which all models of the run have a forecast."""
    models = forecasts.groupBy(*keys).agg(F.count_distinct("model").alias("models"))
    days = forecasts.groupBy(*keys, "day").agg(F.count_distinct("model").alias("there"))
    good = days.join(models, keys).where("there = models").select(*keys, "day")
    return forecasts.join(good, [*keys, "day"], "left_semi")


def simple_average(test: DataFrame, keys: list[str]) -> DataFrame:
    return test.groupBy(*keys, "day").agg(F.first("y").alias("y"), F.avg("y_pred").alias("y_pred"))


def inverse_mse_weights(val: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, w): proportional to one over the validation error."""
    error = val.groupBy(*keys, "model").agg(F.avg((F.col("y") - F.col("y_pred")) ** 2).alias("mse"))
    inverse = 1 / F.greatest("mse", F.lit(1e-12))
    return error.select(*keys, "model", (inverse / F.sum(inverse).over(Window.partitionBy(*keys))).alias("w"))


def on_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection: subtract the level that leaves a positive part summing to one."""
    u = np.sort(v)[::-1]
    level = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(v - level[np.flatnonzero(u > level)[-1]], 0)


def minimum_variance_weights(val: DataFrame, keys: list[str], shrinkage: float = 0.0) -> DataFrame:
    """(keys, model, w): inverse error covariance times ones, on the simplex if some are negative.
    Spark gathers the covariances per pair; only the models x models matrix reaches a group task."""
    errors = val.select(*keys, "day", "model", (F.col("y") - F.col("y_pred")).alias("e"))
    pairs = errors.withColumnRenamed("model", "a").withColumnRenamed("e", "ea").join(errors.withColumnRenamed("model", "b").withColumnRenamed("e", "eb"), [*keys, "day"])
    covariance = pairs.groupBy(*keys, "a", "b").agg(F.covar_samp("ea", "eb").alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        square = pdf.pivot(index="a", columns="b", values="c")
        c = square.to_numpy()
        c = (1 - shrinkage) * c + shrinkage * np.diag(np.diag(c))
        w = np.linalg.pinv(c, hermitian=True).sum(axis=1)
        w = w / w.sum() if abs(w.sum()) > 1e-300 else np.full(len(w), 1 / len(w))
        w = on_simplex(w) if (w < 0).any() else w
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(w) for k in keys}, "model": square.index, "w": w})

    kinds = ", ".join(f"{k} {val.schema[k].dataType.simpleString()}" for k in keys)
    return covariance.groupBy(*keys).applyInPandas(solve, f"{kinds}, model string, w double")


def weighted(test: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    return test.join(weights, [*keys, "model"]).groupBy(*keys, "day").agg(F.first("y").alias("y"), F.sum(F.col("w") * F.col("y_pred")).alias("y_pred"))


def combinations(forecasts: DataFrame, keys: list[str], covariance: bool = True) -> DataFrame:
    """(keys, day, model, y, y_pred) of each combination; pools with one model are left out."""
    val = on_common_days(forecasts.where("split = 'val'"), keys)
    test = on_common_days(forecasts.where("split = 'test'"), keys)
    enough = forecasts.groupBy(*keys).agg(F.count_distinct("model").alias("k")).where("k >= 2").select(*keys)
    test = test.join(enough, keys, "left_semi")
    out = [("AVG", simple_average(test, keys)), ("IMSE", weighted(test, inverse_mse_weights(val, keys), keys))]
    if covariance:
        out.append(("BG", weighted(test, minimum_variance_weights(val, keys), keys)))
    frames = [df.withColumn("model", F.lit(name)) for name, df in out]
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df)
    return result
