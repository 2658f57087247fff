"""Equal-accuracy tests, multiple testing, block bootstrap, confidence sets, efficiency regressions.

Series are long tables with keys, ``rn`` (place from 1 without gaps) and values; keys may be as many
as there are instruments x models. Products with the past are made in blocks, see ``lagged``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.tails import student_p
from tidemark.operators import lagged
from tidemark.operators.spread import dealt
from tidemark.storage import cut


def lag_order(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int")


def placed(rows: DataFrame, keys: list[str], order: str = "day") -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def long_run_variance(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, lrv): Bartlett-weighted, divided by n, not below zero."""
    series = cut(series.select(*keys, "rn", value))  # read twice
    stats = series.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    centred = series.select(*keys, "rn", F.col(value).alias("x")).join(stats, keys).withColumn("e", F.array(F.col("x") - F.col("mean")))
    sums = lagged.weighted(centred, keys, F.col("e"), lag_order(F.col("n")))
    return stats.join(sums, keys).select(*keys, "n", "mean", F.greatest(F.col("s")[0] / F.col("n"), F.lit(0.0)).alias("lrv"))


def diebold_mariano(pairs: DataFrame, keys: list[str], horizon: int = 1, small_sample: bool = True, side: str = "less") -> DataFrame:
    """(keys, n, dm, p_value) for pairs with ``rn``, ``loss_a`` and ``loss_b``: negative when a is
    better. Null where the long-run variance is zero."""
    series = pairs.withColumn("d", F.col("loss_a") - F.col("loss_b"))
    return _tested(long_run_variance(series, keys, "d"), horizon, small_sample, side)


def _tested(stats: DataFrame, h: int, small_sample: bool, side: str) -> DataFrame:
    """Add ``dm`` and ``p_value`` to n, mean and lrv."""
    n = F.col("n")
    dm = F.when(F.col("lrv") > 0, F.col("mean") / F.sqrt(F.col("lrv") / n))
    if small_sample:
        dm = dm * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return stats.withColumn("dm", dm).withColumn("p_value", student_p("dm", (n - 1 if small_sample else F.lit(0)).cast("double"), F.lit(side)))


def pairwise_tests(losses: DataFrame, keys: list[str], loss: str, baseline: str | None = None, horizon: int = 1, small_sample: bool = True, side: str = "less") -> DataFrame:
    """(keys, a, b, n, mean, lrv, dm, p_value) for all ordered pairs of a run's models, or of all with a
    baseline, over the days that all of the run's models have.

    A day is one row with the vector of its losses. The variance of the difference of i and j follows
    from the run's matrix of weighted lagged products as S_ii + S_jj - S_ij - S_ji, so pairs are made
    of matrix cells, never of days. Every model has one loss a day."""
    pair = F.struct(F.col("model").alias("m"), F.col(loss).alias("x"))
    days = losses.groupBy(*keys, "day").agg(F.sort_array(F.collect_list(pair)).alias("v"))
    days = days.withColumn("most", F.max(F.size("v")).over(Window.partitionBy(*keys))).where(F.size("v") == F.col("most"))
    days = cut(placed(days.select(*keys, "day", F.col("v.m").alias("models"), F.col("v.x").alias("x")), keys))
    pos = days.select(*keys, F.posexplode("x").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    stats = pos.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "mean"))), lambda p: p["mean"]).alias("mean"), F.max("n").alias("n"))
    named = days.where("rn = 1").select(*keys, "models")
    centred = days.join(stats, keys).withColumn("e", F.zip_with("x", "mean", lambda x, m: x - m))
    sums = lagged.weighted(centred, keys, F.col("e"), lag_order(F.col("n"))).join(stats, keys).join(named, keys)
    k, at = F.size("models"), F.sequence(F.lit(0), F.size("models") - 1)
    cell = lambda i, j: F.get("s", F.col(i) * k + F.col(j))
    pairs = sums.withColumn("i", F.explode(at)).withColumn("j", F.explode(at)).where("i <> j")
    pairs = pairs.select(
        *keys, F.get("models", F.col("i")).alias("a"), F.get("models", F.col("j")).alias("b"), "n", (F.get("mean", F.col("i")) - F.get("mean", F.col("j"))).alias("mean"),
        F.greatest((cell("i", "i") + cell("j", "j") - cell("i", "j") - cell("j", "i")) / F.col("n"), F.lit(0.0)).alias("lrv"),
    )
    if baseline is not None:
        pairs = pairs.where(F.col("b") == baseline)
    return _tested(pairs, horizon, small_sample, side)


def model_pairs(losses: DataFrame, keys: list[str], loss: str, baseline: str | None = None) -> DataFrame:
    """Loss pairs (keys, a, b, day, loss_a, loss_b) of different models, or of all with a baseline."""
    a = losses.select(*keys, "day", F.col("model").alias("a"), F.col(loss).alias("loss_a"))
    b = losses.select(*keys, "day", F.col("model").alias("b"), F.col(loss).alias("loss_b"))
    if baseline is not None:
        b = b.where(F.col("b") == baseline)
    return a.join(b, [*keys, "day"]).where("a <> b")


def multiple_testing(tests: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Add ``naive``, ``bonferroni``, ``holm`` and ``bh`` to tests with ``p`` and ``test`` (its name).
    Null p-values are never rejected and don't count."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.col("p").asc_nulls_last(), "test")
    m, p = F.col("m"), F.col("p")
    rows = tests.withColumn("m", F.count("p").over(w)).withColumn("i", F.row_number().over(order))
    step = F.when(p <= alpha / (m - F.col("i") + 1), 1).otherwise(0)
    rows = rows.withColumn("holm", F.min(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    top = F.max(F.when(p <= alpha * F.col("i") / m, F.col("i"))).over(w)
    rows = rows.withColumn("bh", F.coalesce(F.col("i") <= top, F.lit(False)) & p.isNotNull())
    never = F.lit(False)
    return rows.withColumn("naive", F.coalesce(p <= alpha, never)).withColumn("bonferroni", F.coalesce(p <= alpha / m, never)).withColumn("holm", F.coalesce("holm", never) & p.isNotNull()).drop("i")


def rejections(tested: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    count = lambda c: F.sum(F.col(c).cast("int")).cast("long").alias(f"n_{c}")
    return tested.groupBy(*by).agg(*[count(c) for c in ("naive", "bonferroni", "holm", "bh")], F.max("m").alias("m")).withColumn("bonferroni_threshold", alpha / F.col("m"))


# --- block bootstrap -------------------------------------------------------------------------

A, C, M = 1103515245, 12345, 1 << 31


#: Draws that a task row makes.
DRAW_BATCH = 500


def bootstrap_means(series: DataFrame, keys: list[str], values: list[str], draws: int, seed: int = 42) -> DataFrame:
    """(keys, draw, <value>_mean...): moving-block means. A series' prefix sums are one row, of a number
    a day; draws are dealt out, ``DRAW_BATCH`` to a row, and a block's sum is the difference of two
    places of that row. Starts come from a linear congruence of (draw, block)."""
    packed = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rn", *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]))).alias("rows"))
    packed = cut(packed.select(*keys, *[F.col(f"rows.v{i}").alias(f"v{i}") for i in range(len(values))]))
    batches = -(-draws // DRAW_BATCH)
    tasks = dealt(packed.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))), packed.count() * batches)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            sums = [np.append(0.0, np.cumsum(np.asarray(getattr(r, f"v{i}"), float))) for i in range(len(values))]
            n = len(sums[0]) - 1
            size = max(1, math.floor(n ** (1 / 3) + 0.5))
            draw = np.arange(r.batch * DRAW_BATCH, min((r.batch + 1) * DRAW_BATCH, draws), dtype=np.int64)
            block = np.arange(-(-n // size), dtype=np.int64)
            mixed = (A * (draw[:, None] * 1009 + block + seed) + C) % M
            lo = (A * mixed + C) % M // 65536 % (n - size + 1)
            hi = lo + np.minimum(size, n - block * size)  # the last block is cut to n
            own = {k: [getattr(r, k)] * len(draw) for k in keys}
            out.append(pd.DataFrame({**own, "draw": draw.astype(np.int32), **{f"{v}_mean": (x[hi] - x[lo]).sum(1) / n for v, x in zip(values, sums, strict=True)}}))
        return pd.concat(out) if out else pd.DataFrame({f.name: [] for f in schema.fields})

    schema = T.StructType([*[packed.schema[k] for k in keys], T.StructField("draw", T.IntegerType()), *[T.StructField(f"{v}_mean", T.DoubleType()) for v in values]])
    return tasks.mapInPandas(lambda batches: map(run, batches), schema)


def interval(means: DataFrame, keys: list[str], value: Column, alpha: float = 0.05) -> DataFrame:
    """Percentile interval and standard error over draws."""
    rows = means.withColumn("v", value)
    q = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return rows.groupBy(*keys).agg(q.alias("q"), F.stddev_samp("v").alias("se")).select(*keys, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "se")


def loss_interval(series: DataFrame, keys: list[str], value: str, draws: int = 1000, alpha: float = 0.05) -> DataFrame:
    return interval(bootstrap_means(series, keys, [value], draws), keys, F.col(f"{value}_mean"), alpha)


def difference_interval(series: DataFrame, keys: list[str], a: str, b: str, draws: int = 1000, alpha: float = 0.05) -> DataFrame:
    return loss_interval(series.withColumn("diff", F.col(a) - F.col(b)), keys, "diff", draws, alpha)


def ratio_interval(series: DataFrame, keys: list[str], top: str, bottom: str, draws: int = 1000, alpha: float = 0.05) -> DataFrame:
    """The same blocks for both; draws with a bottom mean that isn't positive are left out."""
    means = bootstrap_means(series, keys, [top, bottom], draws).where(F.col(f"{bottom}_mean") > 0)
    return interval(means, keys, F.col(f"{top}_mean") / F.col(f"{bottom}_mean"), alpha)


def path_legs(losses: DataFrame, keys: list[str], loss: str, baseline: str, steps: dict[str, str], networks: list[str]) -> DataFrame:
    """(keys, best, leg, day, top, bottom): each step's loss beside that of the step it is measured
    against. ``steps`` names the wide, penalised and forest models; ``best`` is the network of least
    mean loss (the first on ties) over the days that all of them have."""
    models = list(dict.fromkeys([baseline, *steps.values(), *networks]))
    wide = losses.groupBy(*keys, "day").pivot("model", models).agg(F.first(loss)).na.drop(subset=models)
    means = wide.groupBy(*keys).agg(*[F.avg(f"`{m}`").alias(f"n{i}") for i, m in enumerate(networks)])
    best = F.array_min(F.array(*[F.struct(F.col(f"n{i}").alias("mean"), F.lit(i).alias("at")) for i in range(len(networks))]))["at"]
    wide = wide.join(means.select(*keys, F.element_at(F.array(*map(F.lit, networks)), best + 1).alias("best")), keys)
    network = reduce(lambda other, m: F.when(F.col("best") == m, F.col(f"`{m}`")).otherwise(other), networks, F.lit(None).cast("double"))
    at = {k: F.col(f"`{m}`") for k, m in steps.items()} | {"base": F.col(f"`{baseline}`"), "network": network}
    legs = [("wide", "wide", "base"), ("penalised", "penalised", "base"), ("forest", "forest", "penalised"), ("network", "network", "forest"), ("total", "network", "base")]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("leg"), at[a].alias("top"), at[b].alias("bottom")) for n, a, b in legs])).alias("l")
    return wide.select(*keys, "best", "day", long).select(*keys, "best", "day", "l.*")


def first_round_tmax(losses: DataFrame, keys: list[str], loss: str, draws: int) -> DataFrame:
    """(keys, t_max, worst): the largest standardised deviation of a model's mean loss from the
    average over models, with bootstrap standard errors."""
    dev = _deviations(losses, keys, loss)
    means = bootstrap_means(dev, [*keys, "model"], ["d"], draws)
    spread = means.groupBy(*keys, "model").agg(F.stddev_samp("d_mean").alias("sd"))
    centre = dev.groupBy(*keys, "model").agg(F.avg("d").alias("d"))
    t = centre.join(spread, [*keys, "model"]).withColumn("t", F.col("d") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-12))
    return t.groupBy(*keys).agg(F.max("t").alias("t_max"), F.max_by("model", F.struct("t", "model")).alias("worst"))


def _deviations(losses: DataFrame, keys: list[str], loss: str) -> DataFrame:
    w = Window.partitionBy(*keys, "day")
    dev = losses.withColumn("d", F.col(loss) - F.avg(loss).over(w))
    return placed(dev, [*keys, "model"])


def confidence_set(losses: DataFrame, keys: list[str], loss: str, draws: int = 1000, alphas: tuple[float, ...] = (0.25, 0.1, 0.05)) -> DataFrame:
    """(keys, alpha, model, p_value, included). The draws' mean losses are made once in Spark (they
    don't depend on who survives); the elimination sees one draws x models matrix per group."""
    rows = placed(losses.select(*keys, "day", "model", F.col(loss).alias("x")), [*keys, "model"])
    means = bootstrap_means(rows, [*keys, "model"], ["x"], draws).unionByName(rows.groupBy(*keys, "model").agg(F.avg("x").alias("x_mean")).withColumn("draw", F.lit(-1)))

    def eliminate(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="draw", columns="model", values="x_mean").sort_index()
        names, actual, drawn = list(table.columns), table.loc[-1].to_numpy(), table.drop(index=-1).to_numpy()
        out = []
        for alpha in alphas:
            alive, p_of, running = list(range(len(names))), {}, 0.0
            while len(alive) > 1:
                own, boot = actual[alive], drawn[:, alive]
                d = own - own.mean()
                noise = boot - boot.mean(axis=1, keepdims=True) - d
                sd = (noise + d).std(axis=0, ddof=1)
                sd[sd <= 0] = 1e-12
                t = d / sd
                running = max(running, float(((noise / sd).max(axis=1) >= t.max()).mean()))
                if running > alpha:
                    break
                gone = alive.pop(int(t.argmax()))
                p_of[gone] = running
            for i in alive:
                p_of[i] = 1.0 if len(alive) == 1 else running
            out += [(alpha, names[i], p_of[i], i in alive) for i in range(len(names))]
        found = pd.DataFrame(out, columns=["alpha", "model", "p_value", "included"])
        for k in keys:
            found[k] = pdf[k].iloc[0]
        return found

    kinds = ", ".join(f"{k} {losses.schema[k].dataType.simpleString()}" for k in keys)
    return means.groupBy(*keys).applyInPandas(eliminate, f"{kinds}, alpha double, model string, p_value double, included boolean")


# --- efficiency regressions ------------------------------------------------------------------


def mincer_zarnowitz(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a, b, r2, wald, p_value, bias, regression, disturbance): y on y_pred with robust
    covariance, the joint test of a = 0 and b = 1, and the shares of the squared error."""
    rows = placed(forecasts, keys)
    y, p = F.col("y"), F.col("y_pred")
    fit = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_intercept(y, p).alias("a"), F.regr_slope(y, p).alias("b"), F.regr_r2(y, p).alias("r2"),
        F.sum(p).alias("sp"), F.sum(p * p).alias("spp"), F.avg(y).alias("my"), F.avg(p).alias("mp"),
        F.stddev_pop(y).alias("sy"), F.stddev_pop(p).alias("sdp"), F.corr(y, p).alias("rho"), F.avg((y - p) * (y - p)).alias("mse"),
    )
    scored = rows.join(fit, keys).withColumn("e", y - F.col("a") - F.col("b") * p)
    sums = lagged.weighted(scored, keys, F.array("e", F.col("e") * p), lag_order(F.col("n")))
    s = sums.select(*keys, *[F.col("s")[i].alias(c) for i, c in ((0, "s00"), (1, "s01"), (3, "s11"))])
    row = fit.join(s, keys)
    # Wald = q' (X'X) S^-1 (X'X) q for q = (a, b - 1)
    u0 = F.col("n") * F.col("a") + F.col("sp") * (F.col("b") - 1)
    u1 = F.col("sp") * F.col("a") + F.col("spp") * (F.col("b") - 1)
    det = F.col("s00") * F.col("s11") - F.col("s01") * F.col("s01")
    wald = (F.col("s11") * u0 * u0 - 2 * F.col("s01") * u0 * u1 + F.col("s00") * u1 * u1) / det
    gap = F.col("my") - F.col("mp")
    return row.withColumn("wald", wald).select(
        *keys, "n", "a", "b", "r2", "wald", F.exp(-F.col("wald") / 2).alias("p_value"),
        (gap * gap / F.col("mse")).alias("bias"),
        ((F.col("sdp") - F.col("rho") * F.col("sy")) ** 2 / F.col("mse")).alias("regression"),
        ((1 - F.col("rho") * F.col("rho")) * F.col("sy") ** 2 / F.col("mse")).alias("disturbance"),
    )


def autocorrelation(series: DataFrame, keys: list[str], value: str, lags: int, least: str = "pairs") -> DataFrame:
    """(keys, k, acf, band) for k = 0..lags: divided by (n - k) times the variance. Too short is a lag with
    fewer than 5 pairs (``least`` = pairs: that lag is 0) or a series of fewer than lags + 5 rows
    (``series``: all are 0). A constant series has zeros throughout."""
    if least not in ("pairs", "series"):
        raise ValueError(f"unknown rule {least!r}")
    series = cut(series.select(*keys, "rn", F.col(value).alias("x")))  # read twice
    stats = series.groupBy(*keys).agg(F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.count("x").alias("n"))
    sums = lagged.by_lag(series.join(stats.select(*keys, "mean"), keys), keys, F.col("x") - F.col("mean"), lags).join(stats, keys)
    found = sums.select(*keys, F.posexplode("s").alias("k", "s"), "n", "v")
    short = F.col("n") - F.col("k") < 5 if least == "pairs" else F.col("n") < lags + 5
    acf = F.when(F.col("v") <= 0, 0.0).when((least == "series") & short, 0.0).when(F.col("k") == 0, 1.0).when(short, 0.0).otherwise(F.col("s") / ((F.col("n") - F.col("k")) * F.col("v")))
    return found.select(*keys, "k", acf.alias("acf"), (1.96 / F.sqrt("n")).alias("band"))


def error_correlation(forecasts: DataFrame) -> DataFrame:
    """(a, b, corr): correlation of errors of two models over the instrument-days both have, from one
    matrix of counts and products a task. Errors are taken from each model's mean first."""
    e = forecasts.select("instrument", "day", "model", (F.col("y") - F.col("y_pred")).alias("e")).where("e is not null")
    means = cut(e.groupBy("model").agg(F.avg("e").alias("mean")))
    names = sorted(r["model"] for r in means.select("model").collect())  # a name a model
    k, place = len(names), {m: i for i, m in enumerate(names)}
    centred = e.join(F.broadcast(means), "model").select("instrument", "day", F.struct("model", (F.col("e") - F.col("mean")).alias("e")).alias("x"))
    days = centred.groupBy("instrument", "day").agg(F.collect_list("x").alias("x")).select("x")

    def run(batches):
        sums = np.zeros((5, k, k))
        for pdf in batches:
            x, on = np.zeros((len(pdf), k)), np.zeros((len(pdf), k))
            for i, row in enumerate(pdf["x"]):
                at = [place[p["model"]] for p in row]
                x[i, at], on[i, at] = [p["e"] for p in row], 1
            sums += np.stack([on.T @ on, x.T @ on, on.T @ x, x.T @ x, (x * x).T @ on])
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, **{c: s.ravel() for c, s in zip(("n", "si", "sj", "sij", "sii"), sums, strict=True)}})

    cells = days.mapInPandas(run, "i int, j int, n double, si double, sj double, sij double, sii double")
    total = cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij", "sii")]).where("n > 0")
    other = total.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sii").alias("sjj"))
    n = F.col("n")
    both = total.join(other, ["i", "j"])
    corr = (F.col("sij") - F.col("si") * F.col("sj") / n) / F.sqrt((F.col("sii") - F.col("si") ** 2 / n) * (F.col("sjj") - F.col("sj") ** 2 / n))
    named = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return both.select(F.get(named, F.col("i")).alias("a"), F.get(named, F.col("j")).alias("b"), corr.alias("corr"))
