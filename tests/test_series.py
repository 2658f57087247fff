"""Long series: order statistics, lagged products, bootstrap and pairwise tests against plain loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, lagged, order_stats, risk

DAY0 = dt.date(2020, 1, 1)


def days(spark, z, seeds, g="g"):
    """A series whose scaled returns are ``z``; null where z is NaN."""
    pdf = pd.DataFrame({"g": g, "day": [DAY0 + dt.timedelta(days=i) for i in range(len(z))], "ret": z, "rv": 1.0, "rv_hat": 1.0, "seed": np.arange(len(z)) < seeds})
    return spark.createDataFrame(pdf).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret")))


def plain_quantiles(z, seeds, alpha, every):
    out, now = [], None
    for k, t in enumerate(range(seeds, len(z))):
        past = z[:t][~np.isnan(z[:t])]
        if k % every == 0 and len(past):
            now = np.quantile(past, alpha)
        out.append(now)
    return np.array(out, float)


@pytest.mark.parametrize(("block", "every", "alpha"), [(7, 1, 0.05), (7, 5, 0.5), (4, 1, 1.0), (10_000, 1, 0.05)])
def test_running_quantiles_in_blocks(spark, monkeypatch, block, every, alpha):
    monkeypatch.setattr(order_stats, "BLOCK", block)
    rng = np.random.default_rng(block)
    z = np.round(rng.normal(0, 1, 300), 1)  # many ties
    z[rng.integers(0, 300, 20)] = np.nan
    both = days(spark, z, 60).unionByName(days(spark, z[::-1].copy(), 80, "h")).unionByName(days(spark, z[:30], 20, "short")).repartition(3)
    found = risk.expanding_quantile(both, ["g"], alpha, every=every).orderBy("g", "day").toPandas()
    assert set(found["g"]) == {"g", "h"}
    for g, own, seeds in (("g", z, 60), ("h", z[::-1], 80)):
        assert np.allclose(found["var"][found["g"] == g], plain_quantiles(own, seeds, alpha, every))


def test_a_series_of_two_million_days_is_spread(spark):
    n, ask = 2_000_000, 9973
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("at"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000).alias("z"))
    placed = order_stats.place(rows, ["g"], ["at"], "t", {"odd": F.col("at") % 2 == 1})
    points = order_stats.blocked(placed, ["g"], "z", F.col("t") % ask == 0)
    size = 4 * int(np.ceil(np.sqrt(n)))
    for block in ("tb", "rb"):
        cells = points.groupBy(block).count().agg(F.max("count").alias("most"), F.count("*").alias("blocks")).first()
        assert cells["most"] <= size and cells["blocks"] >= n // size
    assert placed.where("t <> at + 1 or odd <> floor(at / 2)").isEmpty()
    z = np.array([r.z for r in rows.orderBy("at").select("z").toLocalIterator()])
    found = {r.t: r.q for r in order_stats.running_quantiles(placed, ["g"], "z", F.col("t") % ask == 0, 0.05).collect()}
    assert len(found) == n // ask
    for t in list(found)[::20]:
        assert np.isclose(found[t], np.quantile(z[: t - 1], 0.05))


def lagged_variance(x, lags):
    e = x - x.mean()
    return (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / len(x)


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_lagged_products_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lagged, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = rng.normal(0, 1, 301).cumsum() / 5 + 1e6
    rows = spark.createDataFrame([("g", i + 1, float(v)) for i, v in enumerate(x)] + [("constant", i + 1, 3.0) for i in range(70)] + [("short", i + 1, float(i)) for i in range(9)], "g string, rn int, x double").repartition(3)
    lrv = {r.g: r for r in inference.long_run_variance(rows, ["g"], "x").collect()}
    assert np.isclose(lrv["g"].lrv, lagged_variance(x, int(4 * 3.01 ** (2 / 9)))) and lrv["g"].n == 301 and lrv["constant"].lrv == 0
    e, var = x - x.mean(), x.var()
    for least in ("pairs", "series"):
        found = inference.autocorrelation(rows, ["g"], "x", 20, least).orderBy("g", "k").toPandas()
        own = found["acf"][found["g"] == "g"].to_numpy()
        assert np.allclose(own, [1.0] + [e[k:] @ e[:-k] / ((301 - k) * var) for k in range(1, 21)])
        assert not found["acf"][found["g"] == "constant"].any() and (found["g"] == "constant").sum() == 21
        short = found["acf"][found["g"] == "short"].to_numpy()
        assert (short[0] == 1 and short[1:5].all() and not short[5:].any()) if least == "pairs" else not short.any()


def test_lags_shuffle_rows_not_rows_times_lags(spark):
    rows = spark.range(1, 100_001).select(F.lit("g").alias("g"), F.col("id").alias("rn"), F.rand(1).alias("x"))
    copies = lagged._blocks(rows, ["g"], F.col("x"), F.lit(250))
    assert copies.count() < 1.1 * 100_000
    assert copies.groupBy("block").count().agg(F.max("count")).first()[0] <= lagged.BLOCK + 250


def forecasts(spark, n=150, models=("A", "B", "C"), missing=()):
    rng = np.random.default_rng(5)
    y = rng.exponential(1, n)
    rows = [("I", DAY0 + dt.timedelta(days=i), m, float(y[i]), float(y[i] + rng.normal(0, 0.3 * (j + 1)))) for j, m in enumerate(models) for i in range(n) if (m, i) not in missing]
    return spark.createDataFrame(rows, "instrument string, day date, model string, y double, y_pred double").withColumn("mse", (F.col("y") - F.col("y_pred")) ** 2)


def test_pairwise_tests_over_common_days(spark):
    rows = forecasts(spark, missing={("B", 3), ("C", 77), ("A", 149)})
    wide = rows.select("day", "model", "mse").toPandas().pivot(index="day", columns="model", values="mse").sort_index().dropna()
    found = {(r.a, r.b): r for r in inference.pairwise_tests(rows, ["instrument"], "mse").collect()}
    assert len(wide) == 147 and len(found) == 6
    for (a, b), r in found.items():
        d = (wide[a] - wide[b]).to_numpy()
        lrv = lagged_variance(d, int(4 * 1.47 ** (2 / 9)))
        assert r.n == 147 and np.isclose(r.lrv, lrv) and np.isclose(r.dm, d.mean() / np.sqrt(lrv / 147) * np.sqrt(146 / 147))
    # a pair by itself agrees, and a model against its copy has no variance
    pair = inference.placed(inference.model_pairs(rows.where("model <> 'C'"), ["instrument"], "mse", "B"), ["instrument", "a", "b"])
    one = inference.diebold_mariano(pair, ["instrument", "a", "b"]).first()
    two = inference.pairwise_tests(rows.where("model <> 'C'"), ["instrument"], "mse", "B").collect()
    assert len(two) == 1 and np.isclose(one.dm, two[0].dm) and np.isclose(one.p_value, two[0].p_value)
    same = rows.where("model = 'A'").unionByName(rows.where("model = 'A'").withColumn("model", F.lit("Z")))
    assert all(r.dm is None for r in inference.pairwise_tests(same, ["instrument"], "mse").collect())


def test_error_correlation_over_the_days_of_both(spark):
    rows = forecasts(spark, missing={("B", i) for i in range(40)} | {("C", 149)})
    wide = rows.withColumn("e", F.col("y") - F.col("y_pred") + 1e5).toPandas().pivot(index="day", columns="model", values="e")
    found = inference.error_correlation(rows).collect()
    assert len(found) == 9
    for r in found:
        both = wide[[r.a, r.b]].dropna() if r.a != r.b else wide[[r.a]].dropna()
        assert np.isclose(r.corr, np.corrcoef(both[r.a], both[r.b])[0, 1], rtol=1e-6)


def test_bootstrap_from_one_row_of_prefix_sums(spark):
    rng = np.random.default_rng(6)
    x, draws = rng.exponential(1, 130), 700
    rows = spark.createDataFrame([(g, i + 1, float(v), float(2 * v)) for g in ("g", "h") for i, v in enumerate(x)], "g string, rn int, x double, z double").repartition(3)
    made = inference.bootstrap_means(rows, ["g"], ["x", "z"], draws)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    found = made.where("g = 'h'").orderBy("draw").toPandas()
    assert found["draw"].tolist() == list(range(draws))
    size = 5
    for draw in (0, 499, 500, 699):
        picked = []
        for block in range(26):
            mixed = (inference.A * ((inference.A * (draw * 1009 + block + 42) + inference.C) % inference.M) + inference.C) % inference.M
            start = mixed // 65536 % (130 - size + 1)
            picked += x[start : start + size].tolist()
        assert np.isclose(found["x_mean"][draw], np.mean(picked[:130])) and np.isclose(found["z_mean"][draw], 2 * np.mean(picked[:130]))


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_of_large_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(order_stats, "ACCURACY", accuracy)  # 20: groups over 80 rows get bounds from a rough sketch
    rng = np.random.default_rng(accuracy)
    groups = {"even": rng.normal(0, 1, 5000), "ties": np.repeat([1.0, 2.0, 3.0], [2000, 5, 2000]), "same": np.full(900, 4.0), "few": np.array([1.0, 5.0]), "one": np.array([7.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("even", None), ("even", float("nan"))], "g string, x double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.73, 1.0]
    found = {r.g: r for r in order_stats.quantiles(rows, ["g"], "x", shares).collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        assert found[g].n == len(x) and np.allclose(found[g].q, np.quantile(x, shares))
    whole = order_stats.quantiles(rows, [], "x", [0.5]).collect()
    assert len(whole) == 1 and np.isclose(whole[0].q[0], np.quantile(np.concatenate(list(groups.values())), 0.5))
