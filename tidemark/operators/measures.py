"""Daily realised measures from intraday returns (instrument, day, order column, price, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bars as B

def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def daily_realised(returns: DataFrame, order: str = "bar", least: int = 2, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per instrument and day: variance, signed semivariances, quarticity, number of
    returns, open-to-close return, and the aggregates ``also``. Days with fewer than ``least`` prices
    go. One aggregate."""
    n, r = F.count("r"), F.col("r")
    return (
        returns.groupBy("instrument", "day")
        .agg(
            _or_zero(F.sum(r * r)).alias("rv"),
            _or_zero(F.sum(F.when(r > 0, r * r).otherwise(0.0))).alias("rv_pos"),
            _or_zero(F.sum(F.when(r < 0, r * r).otherwise(0.0))).alias("rv_neg"),
            _or_zero(n / 3 * F.sum(r * r * r * r)).alias("rq"),
            n.cast("int").alias("n_returns"),
            (F.log(F.max_by("price", order)) - F.log(F.min_by("price", order))).alias("ret"),
            F.count("*").alias("prices"),
            *also,
        )
        .where(F.col("prices") >= least)
        .drop("prices")
    )


def volume_and_price(bars: DataFrame) -> DataFrame:
    """Daily volume and last price of cleaned bars."""
    return bars.groupBy("instrument", B.day().alias("day")).agg(F.sum("volume").alias("volume"), F.max_by("close", "ts").alias("price"))


def daily_measures(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """Cleaned bars to the daily table."""
    measures = daily_realised(B.with_returns(B.sample(bars, minutes)))
    return measures.join(volume_and_price(bars), ["instrument", "day"], "left")


def annualised(daily: DataFrame) -> DataFrame:
    """Variances times 252, quarticity times 252 squared, and volatility in per cent."""
    out = daily.withColumns({c: F.col(c) * 252 for c in ("rv", "rv_pos", "rv_neg")})
    return out.withColumn("rq", F.col("rq") * 252 * 252).withColumn("vol_pct", F.sqrt("rv") * 100)


def parzen(x: Column) -> Column:
    """The Parzen kernel."""
    a = F.abs(x)
    return F.when(a <= 0.5, 1 - 6 * a * a + 6 * a * a * a).when(a <= 1, 2 * (1 - a) * (1 - a) * (1 - a)).otherwise(0.0)


def bandwidth(n: Column, noise: Column, quarticity: Column, scale: float = 3.5134) -> Column:
    """Optimal number of autocovariances. Rounds half to even."""
    best = F.bround(F.lit(scale) * F.pow(noise / F.sqrt(quarticity), F.lit(0.4)) * F.pow(n, F.lit(0.6)))
    return F.greatest(
        F.lit(1), F.when(n < 5, n - 1).when(quarticity <= 0, F.bround(F.sqrt(n))).otherwise(best).cast("int")
    )


def noise_and_quarticity(returns: DataFrame) -> DataFrame:
    """Per day: ``n``, noise variance and integrated quarticity."""
    n, r = F.count("r"), F.col("r")
    return returns.groupBy("instrument", "day").agg(
        n.cast("int").alias("n"), (F.sum(r * r) / (2 * n)).alias("noise"), (n / 3 * F.sum(r * r * r * r)).alias("iq")
    )


def realised_kernel(returns: DataFrame, order: str = "bar", least: int = 5) -> DataFrame:
    """Parzen realised kernel per day, with its bandwidth. Autocovariances are computed in the row
    from one sorted array of the day's returns, which is bounded by the sampling."""
    rows = returns.groupBy("instrument", "day").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct(order, "r")))), lambda s: s.r).alias("rs"), F.count("*").alias("prices")
    )
    rows = rows.where(F.col("prices") >= least)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size("rs")
    rows = rows.withColumn("n", n).withColumn("noise", total(F.transform("rs", lambda x: x * x)) / (2 * n)).withColumn("iq", n / 3 * total(F.transform("rs", lambda x: x * x * x * x)))
    rows = rows.withColumn("bandwidth", F.least(bandwidth(F.col("n"), F.col("noise"), F.col("iq")), F.col("n") - 1))

    def gamma(h: Column) -> Column:
        """Sum of r[j] * r[j - h]; the shorter slice sets the length."""
        late = F.slice(F.col("rs"), h + 1, F.greatest(F.col("n") - h, F.lit(0)))
        early = F.slice(F.col("rs"), F.lit(1), F.greatest(F.col("n") - h, F.lit(0)))
        return total(F.zip_with(late, early, lambda a, b: a * b))

    lags = F.sequence(F.lit(1), F.greatest(F.col("bandwidth"), F.lit(1)))
    weighted = F.transform(lags, lambda h: parzen((h - 1) / F.col("bandwidth")) * gamma(h))
    kernel = gamma(F.lit(0)) + 2 * F.when(F.col("bandwidth") >= 1, total(weighted)).otherwise(0.0)
    return rows.select("instrument", "day", F.greatest(kernel, F.lit(0.0)).alias("rk"), "bandwidth")


def by_frequency(bars: DataFrame, minutes: list[int]) -> DataFrame:
    """Variance and kernel at several sampling intervals: (instrument, day, estimator, value)."""
    out = None
    for k in minutes:
        returns = B.with_returns(B.sample(bars, k))
        rv = daily_realised(returns).select("instrument", "day", F.lit(f"rv_{k}m").alias("estimator"), F.col("rv").alias("value"))
        rk = realised_kernel(returns).select("instrument", "day", F.lit(f"rk_{k}m").alias("estimator"), F.col("rk").alias("value"))
        both = rv.unionByName(rk)
        out = both if out is None else out.unionByName(both)
    return out
