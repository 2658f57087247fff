"""Rolling least squares on sliding-window cross products.

A series is cut into blocks as long as the window. Any window then is the end of one block and the
beginning of the next, so its moments are those of a suffix and a prefix, joined. Both come from
running aggregates within a block (counts, means, centred products, least and greatest target); sums
are never taken from one another, so a level that shifts by many orders leaves no trace in windows
behind it. A row costs as many numbers as there are pairs of columns, whatever the window's length.

One pass of moments serves all models of a run, rolling or fixed: each reads its own part of the matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAGS = ["rvd", "rvw", "rvm"]
#: Eigenvalues below this share of the greatest count as none (collinear regressors).
CUT = 1e-10
_LOG = "log_"
_LEAST_LOG = 1e-16


def _moments(columns: list[str], w: Window) -> Column:
    """Of a frame: count, means, centred products of all pairs, least and greatest last column."""
    n = F.count(F.lit(1)).over(w).cast("double")
    pairs = [F.covar_pop(a, b).over(w) * n for i, a in enumerate(columns) for b in columns[i:]]
    return F.array(n, *[F.avg(c).over(w) for c in columns], *pairs, F.min(columns[-1]).over(w), F.max(columns[-1]).over(w))


def window_moments(rows: DataFrame, keys: list[str], columns: list[str], window: int | str | None, refit: int = 1, embargo: int | Column = 0) -> DataFrame:
    """The test rows with ``begin`` and ``rest``, the moments of the suffix (null: none) and the prefix
    that make up their window. ``rows``: keys, ``rn`` (place from 1 without gaps), ``split`` and columns.

    ``window`` rows end before a test row; ``fit``: as many as come before the first test row; None:
    all earlier rows. Every ``refit`` test rows the window moves on. ``embargo`` ends it earlier, so that
    targets of long horizons don't reach into the day that is forecast; where that leaves fewer rows
    than the window asks for, it begins with the first."""
    by, test = Window.partitionBy(*keys), F.col("split") == "test"
    size = F.lit(1 << 40) if window is None else F.sum((~test).cast("long")).over(by) if window == "fit" else F.lit(window)
    k = F.sum(test.cast("int")).over(by.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumns({"_size": F.greatest(size.cast("long"), F.lit(1)), "_k": k})
    block = lambda at: F.floor((at - 1) / F.col("_size"))
    rows = rows.withColumn("_block", block(F.col("rn")))
    within = Window.partitionBy(*keys, "_block")
    frame = lambda order: within.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stacks = rows.withColumns({"_prefix": _moments(columns, frame(F.col("rn"))), "_suffix": _moments(columns, frame(F.col("rn").desc()))})
    asked = rows.where(test).withColumn("_last", F.col("rn") - 1 - F.col("_k") % refit - embargo).withColumn("_first", F.col("_last") - F.col("_size") + 1)
    asked = asked.withColumn("_first", F.when((F.col("_first") > 1) & (block(F.col("_first")) < block(F.col("_last"))), F.col("_first")))
    asked = asked.join(stacks.select(*keys, F.col("rn").alias("_last").cast("long"), F.col("_prefix").alias("rest")), [*keys, "_last"])
    asked = asked.join(stacks.select(*keys, F.col("rn").alias("_first").cast("long"), F.col("_suffix").alias("begin")), [*keys, "_first"], "left")
    return asked.drop("_first", "_last", "_size", "_k", "_block")


def _unpacked(values: np.ndarray, q: int):
    """(n, mean, centred products, least, greatest) of rows of ``_moments``."""
    n, mean, flat = values[:, 0], values[:, 1 : q + 1], values[:, q + 1 : -2]
    cross = np.empty((len(values), q, q))
    i, j = np.triu_indices(q)
    cross[:, i, j] = cross[:, j, i] = flat
    return n, mean, cross, values[:, -2], values[:, -1]


def joined(begin: np.ndarray, rest: np.ndarray, q: int):
    """Moments of both parts together, by the rule for merging centred products."""
    a, b = _unpacked(begin, q), _unpacked(rest, q)
    n = a[0] + b[0]
    apart = b[1] - a[1]
    mean = a[1] + apart * (b[0] / n)[:, None]
    cross = a[2] + b[2] + apart[:, :, None] * apart[:, None] * (a[0] * b[0] / n)[:, None, None]
    return n, mean, cross, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])


def slopes(cross: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares of the last column on the others, on the correlation scale, for a
    stack of centred product matrices."""
    a, b = cross[:, :-1, :-1], cross[:, :-1, -1]
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 0))
    scale[scale == 0] = 1
    values, vectors = np.linalg.eigh(a / (scale[:, :, None] * scale[:, None]))
    kept = values > CUT * values.max(axis=1, keepdims=True)
    inverse = np.where(kept, 1 / np.where(kept, values, 1), 0)
    turned = np.einsum("bij,bi->bj", vectors, b / scale) * inverse
    return np.einsum("bij,bj->bi", vectors, turned) / scale


def _columns(models: dict[str, list[str]]) -> list[str]:
    """The columns that the models read; the target comes last."""
    plain = dict.fromkeys(c for m, x in models.items() if m != "LogHAR" for c in x)
    logged = [f"{_LOG}{c}" for c in [*models["LogHAR"], "y"]] if "LogHAR" in models else []
    return [*plain, *logged, "y"]


def _with_logs(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({c: F.log(F.greatest(F.col(c.removeprefix(_LOG)), F.lit(_LEAST_LOG))) for c in names if c.startswith(_LOG)})


def _fits(models: dict[str, list[str]], names: list[str], n: np.ndarray, mean: np.ndarray, cross: np.ndarray):
    """(model, places of its columns, means, slopes, residual variance) for a stack of moments."""
    at = {c: i for i, c in enumerate(names)}
    for model, x in models.items():
        own = [at[f"{_LOG}{c}" if model == "LogHAR" else c] for c in [*x, "y"]]
        part = cross[:, own][:, :, own]
        beta = slopes(part)
        left = part[:, -1, -1] - 2 * (beta * part[:, :-1, -1]).sum(1) + np.einsum("bi,bij,bj->b", beta, part[:, :-1, :-1], beta)
        yield model, own[:-1], mean[:, own], beta, np.maximum(left, 0) / np.maximum(n - len(x) - 1, 1)


def rolling_models(rows: DataFrame, keys: list[str], models: dict[str, list[str]], window: int | str | None = "fit", refit: int = 1, embargo: int | Column = 0) -> DataFrame:
    """(keys, day, model, y, y_pred): a forecast per test row and model, refitted on its window.

    ``models`` names the regressors of each. ``LogHAR`` is fitted on logarithms (of at least 1e-16) and
    scaled back by half the residual variance; forecasts of ``HARQ`` stay between the least and the
    greatest target of their window."""
    names = _columns(models)
    found = window_moments(_with_logs(rows, names).select(*keys, "day", "rn", "split", *names), keys, names, window, refit, embargo)
    q = len(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        rest = np.array(pdf["rest"].tolist())
        nothing = np.zeros(rest.shape[1])
        nothing[-2], nothing[-1] = np.inf, -np.inf
        n, mean, cross, low, high = joined(np.array([nothing if b is None else b for b in pdf["begin"]]), rest, q)
        out = []
        for model, own, centre, beta, s2 in _fits(models, names, n, mean, cross):
            here = pdf[[names[i] for i in own]].to_numpy(float)
            guess = centre[:, -1] + ((here - centre[:, :-1]) * beta).sum(1)
            if model == "LogHAR":
                guess = np.exp(guess + s2 / 2)
            if model == "HARQ":
                guess = np.minimum(np.maximum(guess, low), high)
            out.append(pdf[[*keys, "day"]].assign(model=model, y=pdf["y"], y_pred=guess))
        return pd.concat(out)

    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("day", T.DateType()), T.StructField("model", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("y_pred", T.DoubleType())])
    return found.mapInPandas(lambda batches: map(run, batches), schema)


def fixed_models(rows: DataFrame, keys: list[str], models: dict[str, list[str]]) -> DataFrame:
    """(keys, day, split, model, y, y_pred): val rows from one fit on train, test rows from one on train
    and val. All models and both fits come from one aggregation; what is solved is a matrix a group."""
    names = _columns(models)
    rows = _with_logs(rows, names).select(*keys, "day", "split", *names)
    q, asked = len(names), F.when(F.col("split") == "train", F.array(F.lit("val"), F.lit("test"))).otherwise(F.array(F.lit("test")))
    fit = rows.where("split <> 'test'").withColumn("split", F.explode(asked))
    pairs = [F.covar_pop(a, b).alias(f"_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums = fit.groupBy(*keys, "split").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.array(*[F.avg(c) for c in names]).alias("_mean"), F.min("y").alias("_low"), F.max("y").alias("_high"), *pairs)
    products = [F.col(f"_{i}_{j}") * F.col("_n") for i in range(q) for j in range(i, q)]
    sums = sums.select(*keys, "split", F.concat(F.array("_n"), "_mean", F.array(*products), F.array("_low", "_high")).alias("moments"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            n, mean, cross, low, high = _unpacked(np.array(pdf["moments"].tolist()), q)
            for model, own, centre, beta, s2 in _fits(models, names, n, mean, cross):
                wide = np.zeros((len(pdf), q))
                wide[:, own] = beta
                start = centre[:, -1] - (beta * centre[:, :-1]).sum(1)
                out.append(pdf[[*keys, "split"]].assign(model=model, start=start, beta=wide.tolist(), s2=s2, low=low, high=high))
        return pd.concat(out) if out else pd.DataFrame({f.name: [] for f in schema.fields})

    plain = [T.StructField(c, T.DoubleType()) for c in ("s2", "low", "high")]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("split", T.StringType()), T.StructField("model", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("beta", T.ArrayType(T.DoubleType())), *plain])
    scored = rows.where("split <> 'train'").join(sums.mapInPandas(lambda batches: map(run, batches), schema), [*keys, "split"])
    line = F.col("start") + sum(F.col("beta")[i] * F.col(c) for i, c in enumerate(names[:-1]))
    clipped = F.least(F.greatest(line, F.col("low")), F.col("high"))
    guess = F.when(F.col("model") == "LogHAR", F.exp(line + F.col("s2") / 2)).when(F.col("model") == "HARQ", clipped).otherwise(line)
    return scored.select(*keys, "day", "split", "model", "y", guess.alias("y_pred"))
