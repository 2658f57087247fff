"""Products of a series with its own past, in blocks with copied edges.

A series of places 1..n is cut into blocks; each block also gets the rows before it that its lags reach
back to. So n rows and some copies at the edges are shuffled, not n x lags, and a block's products are
matrix products. ``weighted`` sums the products of a vector with its past under falling weights, which
is all that long-run (co)variances need; ``by_lag`` keeps one sum for each lag.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least rows of a block; blocks are at least four times as long as the lags reach.
BLOCK = 4096


def _blocks(rows: DataFrame, keys: list[str], vector: Column, lags: Column) -> DataFrame:
    """(keys, block, rn, own, lags, v): every row in its block, and copies in the blocks after it that reach it."""
    rows = rows.select(*keys, F.col("rn").cast("long").alias("rn"), vector.alias("v"), lags.cast("int").alias("lags"))
    size = F.greatest(F.lit(BLOCK), 4 * F.col("lags")).cast("long")
    block = lambda at: F.floor((at - 1) / size)
    asked = F.sequence(block(F.col("rn")), block(F.col("rn") + F.col("lags")))
    return rows.withColumn("block", F.explode(asked)).withColumn("own", F.col("block") == block(F.col("rn")))


def _summed(rows: DataFrame, keys: list[str], run) -> DataFrame:
    """(keys, s): the arrays that ``run`` makes of each block, added up place by place."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("s", T.ArrayType(T.DoubleType()))])
    made = rows.groupBy(*keys, "block").applyInPandas(run, schema)
    long = made.select(*keys, F.posexplode("s").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))


def weighted(rows: DataFrame, keys: list[str], vector: Column, lags: Column) -> DataFrame:
    """(keys, s): the matrix, flattened, of sums over t of v(t) v(t)' + w_k (v(t) v(t-k)' + v(t-k) v(t)')
    with w_k = 1 - k / (lags + 1). ``lags`` must be the same in all rows of a key, places without gaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        v, own, most = np.array(pdf["v"].tolist()), pdf["own"].to_numpy(), int(pdf["lags"].iloc[0])
        past = np.zeros_like(v)
        for k in range(1, min(most, len(v) - 1) + 1):
            past[k:] += (1 - k / (most + 1)) * v[:-k]
        v, past = v[own], past[own]
        cross = v.T @ past
        return pdf[keys].iloc[:1].assign(s=[(v.T @ v + cross + cross.T).ravel().tolist()])

    return _summed(_blocks(rows, keys, vector, lags), keys, run)


def by_lag(rows: DataFrame, keys: list[str], value: Column, lags: int) -> DataFrame:
    """(keys, s): the sums over t of v(t) v(t-k) for k = 0..lags."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        v, own = pdf["v"].to_numpy(float), pdf["own"].to_numpy()
        here = np.where(own, v, 0.0)
        sums = [float(here[k:] @ v[: len(v) - k]) if k < len(v) else 0.0 for k in range(lags + 1)]
        return pdf[keys].iloc[:1].assign(s=[sums])

    return _summed(_blocks(rows, keys, value, F.lit(lags)), keys, run)
