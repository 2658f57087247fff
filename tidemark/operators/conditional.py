"""Losses conditional on the level of the target or on a regime."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import losses as L
from tidemark.operators import order_stats
from tidemark.operators.spread import dealt, with_tasks
from tidemark.storage import cut


def with_decile(forecasts: DataFrame, keys: list[str], bins: int = 10, by: tuple[str, ...] = ("day",), large: bool = False) -> DataFrame:
    """Add ``decile`` (1..bins) of the observed target within ``keys``: one more than the number of
    inner linear-quantile edges that are not above it. The target counts once for each of ``by``. A
    group's targets are counted in one task's map; with ``large``, for groups that pool many series,
    edges are selected without gathering a group anywhere."""
    if not keys:
        return with_decile(forecasts.withColumn("_all", F.lit(0)), ["_all"], bins, by, large).drop("_all")
    days, inner = forecasts.select(*keys, *by, "y").distinct(), [i / bins for i in range(1, bins)]
    if large:
        edges = order_stats.quantiles(days, keys, "y", inner).select(*keys, F.col("q").alias("edges"))
    else:
        edges = days.groupBy(*keys).agg(F.percentile("y", F.array(*map(F.lit, inner))).alias("edges"))
    place = F.size(F.filter("edges", lambda e: e <= F.col("y"))) + 1
    return forecasts.join(edges, keys).withColumn("decile", place).drop("edges")


def decile_losses(forecasts: DataFrame, keys: list[str], bins: int = 10, by: tuple[str, ...] = ("day",), large: bool = False) -> DataFrame:
    """(keys, decile, model, loss, value, n); each decile is a slice of its own."""
    rows = with_decile(forecasts, keys, bins, by, large)
    counts = rows.groupBy(*keys, "decile", "model").agg(F.count("*").alias("n"))
    return L.mean_losses(rows, [*keys, "decile", "model"]).join(counts, [*keys, "decile", "model"])


def regime_losses(forecasts: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regime, model, loss, value) given (instrument, day, regime)."""
    return L.mean_losses(forecasts.join(labels, ["instrument", "day"]), [*keys, "regime", "model"])


def regime_ratios(table: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """Ratios to the baseline where its loss is positive."""
    found = L.ratios(table, baseline, [*keys, "regime", "loss"])
    base = F.max(F.when(F.col("model") == baseline, F.col("value"))).over(Window.partitionBy(*keys, "regime", "loss"))
    return found.withColumn("base", base).where("base > 0").drop("base")


def regime_fits(daily: DataFrame, value: str = "rv", restarts: int = 25, rounds: int = 200, batch: int = 5) -> DataFrame:
    """(instrument, params, likelihood, shift, scale, rows): a two-state Gaussian Markov chain on
    standardised log ``value`` by EM, the best of ``restarts`` starts. A task runs ``batch`` starts of
    one instrument; ``rows`` are its days in order, bounded by the calendar."""
    series = daily.where(F.col(value) > 0).select("instrument", "day", F.log(value).alias("x"))
    stats = series.groupBy("instrument").agg(F.avg("x").alias("shift"), F.stddev_pop("x").alias("scale"))
    z = (F.col("x") - F.col("shift")) / F.col("scale")
    packed = series.join(stats, "instrument").groupBy("instrument", "shift", "scale").agg(F.sort_array(F.collect_list(F.struct("day", z.alias("z")))).alias("rows"))
    packed = cut(packed)
    tasks = [{"first": i, "many": min(batch, restarts - i)} for i in range(0, restarts, batch)]

    def fit(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                z = np.array([row["z"] for row in r["rows"]])
                params, likelihood = _em(z, np.stack([_start(z, i) for i in range(r["first"], r["first"] + r["many"])]), rounds)
                yield pd.DataFrame({"instrument": r["instrument"], "start": range(r["first"], r["first"] + r["many"]), "params": params.tolist(), "likelihood": likelihood})

    asked = with_tasks(packed.select("instrument", "rows"), ["instrument"], tasks, 32)
    fits = asked.mapInPandas(fit, "instrument string, start int, params array<double>, likelihood double")
    best = fits.groupBy("instrument").agg(F.max_by(F.struct("params", "likelihood"), F.struct("likelihood", -F.col("start"))).alias("b")).select("instrument", "b.*")
    return packed.join(best, "instrument")


def fit_regimes(daily: DataFrame, value: str = "rv", restarts: int = 25, rounds: int = 200) -> DataFrame:
    """(instrument, day, p_high, regime): smoothed probabilities of the state with the higher mean."""

    def smooth(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                params, z = np.array(r["params"]), np.array([row["z"] for row in r["rows"]])
                high = _forward_backward(z, params[None])[0][:, 0, int(params[1] > params[0])]
                yield pd.DataFrame({"instrument": r["instrument"], "day": [row["day"] for row in r["rows"]], "p_high": high, "regime": (high >= 0.5).astype("int32")})

    fits = cut(regime_fits(daily, value, restarts, rounds))
    return dealt(fits, fits.count()).mapInPandas(smooth, "instrument string, day date, p_high double, regime int")


def regime_parameters(fits: DataFrame) -> DataFrame:
    """(instrument, regime, log_mean, log_variance, stay, share): the states of the fitted chains, low
    (0) and high (1), in units of the logs; ``share`` is the chain's long-run share of days."""
    p = lambda i, high: F.col("params")[F.when((F.col("params")[1] > F.col("params")[0]) == F.lit(high), 1).otherwise(0) + i]
    leave = lambda high: 1 - p(4, high)
    states = [
        F.struct(F.lit(int(h)).alias("regime"), (F.col("shift") + F.col("scale") * p(0, h)).alias("log_mean"), (F.col("scale") ** 2 * F.greatest(p(2, h), F.lit(1e-6))).alias("log_variance"), p(4, h).alias("stay"), (leave(not h) / (leave(h) + leave(not h))).alias("share"))
        for h in (False, True)
    ]
    return fits.select("instrument", F.explode(F.array(*states)).alias("s")).select("instrument", "s.*")


def _start(z: np.ndarray, restart: int) -> np.ndarray:
    """Means, variances and staying probabilities: quantiles first, then jittered by the restart."""
    rng = np.random.default_rng(restart)
    means = np.quantile(z, [0.25, 0.75]) + (rng.normal(0, 0.3, 2) if restart else 0)
    return np.array([*means, 0.5, 0.5, *(rng.uniform(0.7, 0.99, 2) if restart else (0.95, 0.95))])


def _forward_backward(z: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[day, start, state] smoothed probabilities, [start, from, to] expected moves and [start] log
    likelihoods, by scaled recursions over all starts at once."""
    mean, var, stay = params[:, :2], np.maximum(params[:, 2:4], 1e-6), params[:, 4:6]
    move = np.stack([np.stack([stay[:, 0], 1 - stay[:, 0]], -1), np.stack([1 - stay[:, 1], stay[:, 1]], -1)], 1)
    density = np.exp(-((z[:, None, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) + 1e-300
    n, back_move = len(z), move.transpose(0, 2, 1)
    ahead, scale, back = np.empty(density.shape), np.empty((n, len(params), 1)), np.ones(density.shape)
    state = np.full((len(params), 1, 2), 0.5)
    for t in range(n):
        state = (state @ move if t else state) * density[t][:, None]
        scale[t] = state.sum(axis=2)
        state = state / scale[t][:, None]
        ahead[t] = state[:, 0]
    now = np.ones((len(params), 1, 2))
    for t in range(n - 2, -1, -1):
        now = ((density[t + 1] / scale[t + 1])[:, None] * now) @ back_move
        back[t] = now[:, 0]
    smooth = ahead * back
    moves = np.einsum("tri,rij,trj->rij", ahead[:-1], move, density[1:] * back[1:] / scale[1:])
    return smooth / smooth.sum(axis=2, keepdims=True), moves, np.log(scale).sum(axis=(0, 2))


def _em(z: np.ndarray, params: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and log likelihood of each start; a start that has converged stays as it is."""
    last, going = np.full(len(params), -np.inf), np.arange(len(params))
    for _ in range(rounds):
        smooth, moves, likelihood = _forward_backward(z, params[going])
        on = likelihood - last[going] >= 1e-7 * np.abs(likelihood)
        going, smooth, moves = going[on], smooth[:, on], moves[on]
        if not len(going):
            break
        last[going] = likelihood[on]
        weight = smooth.sum(axis=0)
        mean = np.einsum("trs,t->rs", smooth, z) / weight
        var = np.maximum(np.einsum("trs,trs->rs", smooth, (z[:, None, None] - mean) ** 2) / weight, 1e-4)
        stay = np.clip(np.einsum("rii->ri", moves) / moves.sum(axis=2), 1e-4, 1 - 1e-4)
        params[going] = np.concatenate([mean, var, stay], axis=1)
    return params, last
