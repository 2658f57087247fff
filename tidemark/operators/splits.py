"""Chronological splits. All add ``split`` (train, val, test) and ``rn``, the row's place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumn("rn", F.row_number().over(w.orderBy("day"))).withColumn("n", F.count("*").over(w))


def _named(train: Column, val: Column) -> Column:
    return F.when(train, "train").when(val, "val").otherwise("test")


#: Columns that only the linear lag models read.
LAG_MODEL_ONLY = ["rvd_pos", "rvd_neg", "rn_d", "rn_w", "rn_m", "rq_x_rv", "rq_lag"]
#: Columns that place a row.
PLACE = ["instrument", "day", "horizon", "split", "rn", "n"]


def model_columns(rows: DataFrame, feature_set: str) -> DataFrame:
    """What a model sees beside a row's place: the three lags and the target for ``M_HAR``, everything
    but the columns of the linear lag models for ``M_ALL``. Missing lags are an error."""
    if missing := [c for c in ("rvd", "rvw", "rvm", "y") if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    if feature_set not in ("M_HAR", "M_ALL"):
        raise ValueError(f"unknown feature set {feature_set!r}")
    seen = ["rvd", "rvw", "rvm", "y"] if feature_set == "M_HAR" else [c for c in rows.columns if c not in LAG_MODEL_ONLY]
    return rows.select(*[c for c in rows.columns if c in PLACE or c in seen])


def by_fraction(rows: DataFrame, keys: list[str], train: float = 0.7, val: float = 0.1) -> DataFrame:
    n = F.col("n").cast("double")
    first, second = F.floor(n * train), F.floor(n * val)
    return _placed(rows, keys).withColumn("split", _named(F.col("rn") <= first, F.col("rn") <= first + second))


def by_date(rows: DataFrame, keys: list[str], train_end: str, val_end: str) -> DataFrame:
    return _placed(rows, keys).withColumn("split", _named(F.col("day") <= F.to_date(F.lit(train_end)), F.col("day") <= F.to_date(F.lit(val_end))))


def by_size(rows: DataFrame, keys: list[str], train: int, val: int = 200) -> DataFrame:
    """The first rows train, the next validate, all others test; groups without a test row go."""
    placed = _placed(rows, keys).where(F.col("n") > train + val)
    return placed.withColumn("split", _named(F.col("rn") <= train, F.col("rn") <= train + val))


def guarded(split: DataFrame, keys: list[str], train: int = 50, val: int = 20, test: int = 50) -> DataFrame:
    """Per group, the sizes of its splits and whether it is ``rejected`` for too little history."""
    count = lambda s: F.sum(F.when(F.col("split") == s, 1).otherwise(0)).cast("long")
    sizes = split.groupBy(*keys).agg(count("train").alias("n_train"), count("val").alias("n_val"), count("test").alias("n_test"))
    return sizes.withColumn("rejected", (F.col("n_train") < train) | (F.col("n_val") < val) | (F.col("n_test") < test))


def floored(forecasts: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Forecasts clipped below at the group's least training target (a tiny number if not positive)."""
    low = train.groupBy(*keys).agg(F.min("y").alias("least"))
    low = low.withColumn("least", F.when(F.col("least") > 0, F.col("least")).otherwise(1e-12))
    return forecasts.join(low, keys).withColumn("y_pred", F.greatest("y_pred", "least")).drop("least")
