"""Value-at-Risk by filtered historical simulation, and its back-tests.

Input rows: keys, day, ret, rv (realised), rv_hat (forecast), ``seed`` (true on calibration days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tails import chi1_p
from tidemark.operators import order_stats

TINY = 1e-12


def _scaled(rows: DataFrame, realised: bool) -> DataFrame:
    scale = F.col("rv") if realised else F.col("rv_hat")
    return rows.withColumn("z", F.col("ret") / F.sqrt(F.greatest(scale, F.lit(TINY))))


def fixed_quantile(rows: DataFrame, keys: list[str], alpha: float, realised: bool = True, least: int = 50) -> DataFrame:
    """Test rows with ``var`` and ``hit``: the quantile of scaled calibration returns times the
    forecast volatility. Groups with fewer than ``least`` calibration days go."""
    z = _scaled(rows, realised)
    q = z.where("seed").groupBy(*keys).agg(F.percentile("z", alpha).alias("q"), F.count("z").alias("n_seed")).where(F.col("n_seed") >= least)
    return _judged(z.where("not seed").join(q, keys), alpha)


def expanding_quantile(rows: DataFrame, keys: list[str], alpha: float, realised: bool = True, least: int = 50, every: int = 1) -> DataFrame:
    """As ``fixed_quantile``, with all scaled returns strictly before the day; recalibrated every
    ``every`` test days and carried forward in between. Series may be of any length: their order
    statistics come from blocks of days and of ranks, see ``order_stats``."""
    z = order_stats.place(_scaled(rows, realised), keys, ["day"], "t", {"k": ~F.col("seed"), "n_seed": F.col("seed")})
    z = z.where(F.col("n_seed_n") >= least)
    q = order_stats.running_quantiles(z, keys, "z", ~F.col("seed") & (F.col("k") % every == 0), alpha)
    asked = z.where(~F.col("seed")).withColumn("at", F.col("t"))
    if every > 1:  # a row takes the answer of the last recalibration before it
        told = z.where(~F.col("seed") & (F.col("k") % every == 0)).select(*keys, F.col("k").alias("at"), "t").join(q, [*keys, "t"], "left").drop("t")
        asked = asked.withColumn("at", F.col("k") - F.col("k") % every)
    else:
        told = q.withColumnRenamed("t", "at")
    return _judged(asked.join(told, [*keys, "at"], "left").drop("at", "t", "t_n", "k", "k_n", "n_seed_n"), alpha)


def _judged(rows: DataFrame, alpha: float) -> DataFrame:
    var = F.col("q") * F.sqrt(F.greatest("rv_hat", F.lit(TINY)))
    rows = rows.withColumn("alpha", F.lit(alpha)).withColumn("var", var).withColumn("hit", (F.col("ret") <= F.col("var")).cast("int"))
    return rows.withColumn("tick", pinball(F.col("ret"), F.col("var"), F.lit(alpha))).drop("q", "z", "n_seed")


def pinball(ret: Column, var: Column, alpha: Column) -> Column:
    return (alpha - F.when(ret <= var, 1.0).otherwise(0.0)) * (ret - var)


def _loglik(n: Column, p: Column) -> Column:
    """n log p; 0 where the probability is 0 or 1."""
    return F.when((p > 0) & (p < 1), n * F.log(p)).otherwise(0.0)


def coverage(judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alpha, n, hits, expected, rate, mean_tick, lr_uc, p_uc, lr_ind, lr_cc, p_cc)."""
    by = [*keys, "alpha"]
    rows = judged.withColumn("before", F.lag("hit").over(Window.partitionBy(*by).orderBy("day")))
    moved = lambda a, b: F.sum(F.when((F.col("before") == a) & (F.col("hit") == b), 1).otherwise(0)).cast("double").alias(f"n{a}{b}")
    row = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"), F.avg("tick").alias("mean_tick"), moved(0, 0), moved(0, 1), moved(1, 0), moved(1, 1)
    )
    n, x, a = F.col("n").cast("double"), F.col("hits").cast("double"), F.col("alpha")
    rate = F.least(F.greatest(x / n, F.lit(TINY)), F.lit(1 - TINY))
    lr_uc = -2 * ((n - x) * F.log(1 - a) + x * F.log(a) - (n - x) * F.log(1 - rate) - x * F.log(rate))
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    share = lambda top, rest: F.when(top + rest > 0, top / (top + rest)).otherwise(0.0)
    p0, p1, p = share(n01, n00), share(n11, n10), share(n01 + n11, n00 + n10)
    one = _loglik(n00 + n10, 1 - p) + _loglik(n01 + n11, p)
    two = _loglik(n00, 1 - p0) + _loglik(n01, p0) + _loglik(n10, 1 - p1) + _loglik(n11, p1)
    row = row.withColumn("lr_uc", F.greatest(lr_uc, F.lit(0.0))).withColumn("lr_ind", F.greatest(-2 * (one - two), F.lit(0.0)))
    row = row.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    return row.select(*by, "n", "hits", (n * a).alias("expected"), (x / n).alias("rate"), "mean_tick", "lr_uc", chi1_p("lr_uc").alias("p_uc"), "lr_ind", "lr_cc", F.exp(-F.col("lr_cc") / 2).alias("p_cc"))
