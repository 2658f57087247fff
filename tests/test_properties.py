"""Analytic and property checks on small synthetic series."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import bars as B
from tidemark.operators import combine, conditional, explain, inference, learners, linear, losses, risk, splits, spread
from tidemark.operators import measures as D
from tidemark.sources import files

DAY0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def minute_bars(spark):
    rows = []
    for day in range(2):
        for m in range(390):
            ts = dt.datetime(2020, 1, 2 + day, 9, 30) + dt.timedelta(minutes=m)
            rows.append(("X", ts, 100 * math.exp(1e-4 * (m + 1)), 100.0))
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, close double, volume double")


def test_sampling_and_variance(minute_bars):
    daily = D.daily_realised(B.with_returns(B.sample(minute_bars, 5))).collect()
    for r in daily:
        assert r.n_returns == 78
        assert math.isclose(r.rv, 77 * (5e-4) ** 2 + (4e-4) ** 2, rel_tol=1e-9)
        assert math.isclose(r.rv_pos + r.rv_neg, r.rv, rel_tol=1e-12)
        assert math.isclose(r.ret, 389e-4, rel_tol=1e-9)


def test_kernel_and_parzen(spark, minute_bars):
    ends = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "x double").select(D.parzen(F.col("x"))).collect()
    assert [r[0] for r in ends] == [1.0, 0.25, 0.0, 0.0]
    assert all(r.rk >= 0 and r.bandwidth >= 1 for r in D.realised_kernel(B.with_returns(B.sample(minute_bars, 5))).collect())


def test_outlier_and_buckets(spark, minute_bars):
    spiked = minute_bars.withColumn("close", F.when(F.minute("ts") == 17, F.col("close") * 1.5).otherwise(F.col("close")))
    whole = B.outlier_flags(spiked).where("outlier").select("ts").collect()
    parts = B.outlier_flags(spiked, bucket_rows=120).where("outlier").select("ts").collect()
    assert {r.ts for r in whole} == {r.ts for r in parts} and len(whole) >= 12


def test_bar_files(spark, tmp_path):
    (tmp_path / "AB.csv").write_text("01/02/2020,09:30,1,2,0.5,1.5,10\n01/02/2020,09:31,1,2,0.5,bad,10\n")
    rows = files.read_bars(spark, str(tmp_path)).collect()
    assert [(r.instrument, r.close, str(r.ts)) for r in rows] == [("AB", 1.5, "2020-01-02 09:30:00")]
    (tmp_path / "e.json").write_text('{"A": ["2020-01-02", "2020-01-02"], "B": ["2021-05-06"]}')
    assert {(r.instrument, str(r.day)) for r in files.read_event_days(spark, str(tmp_path / "e.json")).collect()} == {("A", "2020-01-02"), ("B", "2021-05-06")}


def frame(spark, n=400, models=("A", "B", "C"), seed=1):
    rng = np.random.default_rng(seed)
    y = rng.exponential(1, n)
    out = [("I", DAY0 + dt.timedelta(days=i), m, "val" if i < n // 2 else "test", float(y[i]), float(abs(y[i] + rng.normal(0, 0.2 * (k + 1))))) for k, m in enumerate(models) for i in range(n)]
    return spark.createDataFrame(out, "instrument string, day date, model string, split string, y double, y_pred double")


def test_losses(spark):
    rows = frame(spark)
    same = losses.mean_losses(rows.withColumn("y_pred", F.col("y")), ["model"]).collect()
    assert all(abs(r.value) < 1e-12 for r in same)
    with pytest.raises(ValueError):
        losses.mean_losses(rows, ["model"], "nope")
    ratio = losses.ratios(losses.mean_losses(rows, ["instrument", "model"], "mse"), "A", ["instrument"]).collect()
    assert {r.model: r.ratio for r in ratio}["A"] == 1.0


def test_efficiency_regression(spark):
    perfect = inference.mincer_zarnowitz(frame(spark).withColumn("y_pred", F.col("y_pred")), ["instrument", "model"]).collect()
    assert all(math.isclose(r.bias + r.regression + r.disturbance, 1, rel_tol=1e-6) for r in perfect)
    halved = inference.mincer_zarnowitz(frame(spark, models=("A",)).withColumn("y_pred", F.col("y_pred") / 2), ["model"]).first()
    assert 1.5 < halved.b < 2.1 and halved.p_value < 1e-6


def test_better_model_and_tails(spark):
    rows = losses.with_losses(frame(spark), ["instrument", "model"])
    pairs = inference.placed(inference.model_pairs(rows, ["instrument"], "mse", "C"), ["instrument", "a", "b"])
    found = {r.a: r for r in inference.diebold_mariano(pairs, ["instrument", "a", "b"]).collect()}
    assert found["A"].dm < -3 and found["A"].p_value < 0.01
    assert math.isclose(tails._t_upper(2.0, 10), 0.03669401738537018, rel_tol=1e-9)
    assert math.isclose(tails._t_upper(-1.5, 5), 1 - 0.09695184012123626, rel_tol=1e-9)


def test_multiple_testing_order(spark):
    p = [0.001] * 5 + [0.02, 0.3, 0.9]
    rows = spark.createDataFrame([("g", str(i), v) for i, v in enumerate(p)] + [("g", "n", None)], "g string, test string, p double")
    s = inference.rejections(inference.multiple_testing(rows, ["g"]), ["g"]).first()
    assert s.n_naive >= s.n_bh >= s.n_holm >= s.n_bonferroni == 5 and s.m == 8


def test_intervals(spark):
    rng = np.random.default_rng(3)
    x, base = rng.exponential(1, 300), rng.exponential(1, 300)
    rows = spark.createDataFrame([("g", i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(x, base, strict=True))], "g string, rn int, a double, b double")
    r = inference.loss_interval(rows, ["g"], "a", 300).first()
    assert r.lower < x.mean() < r.upper and r.se > 0
    r = inference.ratio_interval(rows, ["g"], "a", "b", 300).first()
    assert r.lower < x.mean() / base.mean() < r.upper


def test_confidence_set_keeps_the_best(spark):
    rows = losses.with_losses(frame(spark), ["instrument", "model"])
    found = inference.confidence_set(rows, ["instrument"], "mse", 200).where("alpha = 0.1").collect()
    assert {r.model: r.included for r in found}["A"] and not {r.model: r.included for r in found}["C"]


def test_combination_weights(spark):
    val = frame(spark).where("split = 'val'")
    for weights in (combine.inverse_mse_weights(val, ["instrument"]), combine.minimum_variance_weights(val, ["instrument"])):
        w = {r.model: r.w for r in weights.collect()}
        assert math.isclose(sum(w.values()), 1, rel_tol=1e-9) and min(w.values()) >= 0 and w["A"] == max(w.values())


def test_deciles(spark):
    rows = frame(spark, 200, ("A",)).withColumn("split", F.lit("test"))
    assert {r.n for r in conditional.decile_losses(rows, ["instrument"]).where("loss = 'mse'").collect()} == {20}


def test_coverage(spark):
    hits = [1] * 20 + [0] * 180
    rows = spark.createDataFrame([("g", i, 0.05, h, 0.1) for i, h in enumerate(hits)], "g string, day int, alpha double, hit int, tick double")
    r = risk.coverage(rows, ["g"]).first()
    assert r.hits == 20 and r.p_uc < 0.01 and r.p_cc < 1e-6


def test_linear_recovers_coefficients(spark):
    rng = np.random.default_rng(42)
    x = rng.exponential(1e-4, (2000, 3))
    y = 1e-4 + x @ np.array([0.5, 0.3, 0.15]) + rng.normal(0, 1e-7, 2000)
    pdf = pd.DataFrame(x, columns=linear.HAR).assign(y=y, g="g", day=[DAY0 + dt.timedelta(days=i) for i in range(2000)], rn=range(1, 2001))
    rows = spark.createDataFrame(pdf).withColumn("split", F.when(F.col("rn") > 1900, "test").otherwise("train"))
    beta = linear.ols(rows, ["g"], linear.HAR).first()
    assert np.allclose(beta.beta, [0.5, 0.3, 0.15], atol=1e-3) and abs(beta.intercept - 1e-4) < 1e-6
    twin = linear.ols(rows.withColumn("rvz", F.col("rvd")), ["g"], [*linear.HAR, "rvz"]).first()
    assert np.allclose(twin.beta, [0.25, 0.3, 0.15, 0.25], atol=1e-3)
    rolled = linear.rolling_forecast(rows, ["g"], linear.HAR, 500, refit=5).toPandas().sort_values("day")
    for k in (0, 57, 99):
        at = 1900 + k - k % 5
        a = np.column_stack([np.ones(500), x[at - 500 : at]])
        b = np.linalg.lstsq(a, y[at - 500 : at], rcond=None)[0]
        assert math.isclose(rolled["y_pred"].iloc[k], float(b @ [1, *x[1900 + k]]), rel_tol=1e-6)
    lasso = linear.PENALISED["LA"]
    cross = np.array(linear.moments(rows, ["g"], linear.HAR).first().cross).reshape(4, 4)
    assert not lasso(cross, 2000, 1.0, 1.0).any()


def test_regimes_recovered(spark):
    rng = np.random.default_rng(7)
    state, path = 0, []
    for _ in range(600):
        state = state if rng.random() < 0.97 else 1 - state
        path.append(state)
    x = np.where(np.array(path) == 1, rng.normal(-7.5, 0.6, 600), rng.normal(-9.5, 0.4, 600))
    rows = spark.createDataFrame([("I", DAY0 + dt.timedelta(days=i), float(np.exp(v))) for i, v in enumerate(x)], "instrument string, day date, rv double")
    found = conditional.fit_regimes(rows, restarts=2, rounds=60).toPandas().sort_values("day")
    assert (found["regime"].to_numpy() == np.array(path)).mean() > 0.9


def learner_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.1 * rng.normal(size=400)
    split = ["train"] * 250 + ["val"] * 50 + ["test"] * 100
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, split=split, g="g", day=[DAY0 + dt.timedelta(days=i) for i in range(400)])
    return spark.createDataFrame(pdf), y


def test_trees_boosting_networks(spark):
    rows, y = learner_rows(spark)
    for made in (
        learners.forest(rows, ["g"], ["a", "b", "c"], 6, None, "BG", batch=3),
        learners.boosting(rows, ["g"], ["a", "b", "c"], [5, 30], [0.2], [2]),
        learners.networks(rows, ["g"], ["a", "b", "c"], "NN2", 3, 60, 2).where("model = 'NN2^2'"),
    ):
        r = made.where("split = 'test'").agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col("y_pred")) ** 2).alias("mse")).first()
        assert r.n == 100 and r.mse < 0.8 * np.var(y)


def test_effects_and_shares(spark):
    rows, _ = learner_rows(spark)
    score = explain.by_column(lambda v: 2 * v["a"] + v["b"], ["a", "b", "c"])
    vi = {r.feature: r.vi for r in explain.importance(explain.all_effects(rows, ["g"], score, ["a", "b", "c"], 10), ["g"]).collect()}
    assert math.isclose(sum(vi.values()), 1, rel_tol=1e-9) and vi["a"] > vi["b"] > vi["c"] == 0
    share = {r.feature: r.share for r in explain.shapley_shares(rows.limit(50), ["g"], score, ["a", "b", "c"], rows, 4).collect()}
    assert math.isclose(sum(share.values()), 1, rel_tol=1e-9) and share["a"] > share["b"] > share["c"]


def test_fits_are_dealt_out(spark):
    """Members, grid points and restarts get tasks of their own, whatever adaptive execution makes of
    their bytes; each task has one of them."""
    rows, _ = learner_rows(spark)
    fit = lambda split, features, target, task: iter([(target, (task["seed"],))])
    made = learners.members(rows, ["g"], ["a", "b", "c"], [{"seed": i} for i in range(12)], fit, "seed int")
    tasks = made.select(F.spark_partition_id().alias("task"), "seed").distinct().groupBy("task").count().collect()
    assert len(tasks) == 12
    packed = spread.with_tasks(learners._packed(rows, ["g"], ["a"]), ["g"], [{"k": i} for i in range(5)], 1 << 30)  # too large to broadcast
    assert packed.select(F.spark_partition_id().alias("task")).distinct().count() == 5
    grid = spread.dealt(spark.range(200), 200, 25)
    assert grid.groupBy(F.spark_partition_id()).count().count() == 8


def test_tree_against_exhaustive_splits():
    """Each node's split is the best one there is, and a full tree returns its own targets."""
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(60, 3)), 1), rng.normal(size=60)
    feature, threshold, left, right, value = tree = learners.grow(x, y, rng, 3, 1000)
    rows = {0: np.arange(60)}
    for at in range(len(feature)):
        own = rows[at]
        assert math.isclose(value[at], y[own].mean(), abs_tol=1e-12)
        gains = {}
        for f in range(3):
            for t in np.unique(x[own, f])[:-1]:
                a, b = y[own][x[own, f] <= t], y[own][x[own, f] > t]
                gains[f, t] = len(a) * a.mean() ** 2 + len(b) * b.mean() ** 2 - len(own) * y[own].mean() ** 2
        if feature[at] < 0:
            assert not gains or max(gains.values()) < 1e-9
            continue
        go = x[own, feature[at]] <= threshold[at]
        a, b = y[own][go], y[own][~go]
        assert math.isclose(len(a) * a.mean() ** 2 + len(b) * b.mean() ** 2 - len(own) * y[own].mean() ** 2, max(gains.values()), rel_tol=1e-9)
        rows[left[at]], rows[right[at]] = own[go], own[~go]
    assert np.allclose(learners.fall(tree, x), [y[(x == r).all(axis=1)].mean() for r in x])
    stump = learners.grow(x, y, rng, 3, 1)
    assert len(stump[0]) == 3


def test_networks_and_regimes_together_are_those_alone():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3))
    y = x[:, 0] - 0.5 * np.abs(x[:, 1])
    both = learners._networks(x, y, x, [4, 2], [1, 2, 3], 40, patience=5)
    for i, seed in enumerate((1, 2, 3)):
        assert np.allclose(both[i], learners._networks(x, y, x, [4, 2], [seed], 40, patience=5)[0])
    z = np.concatenate([rng.normal(-1, 0.3, 80), rng.normal(1.5, 0.5, 80)])
    starts = np.stack([conditional._start(z, i) for i in range(3)])
    params, likelihood = conditional._em(z, starts.copy(), 50)
    for i in range(3):
        alone, value = conditional._em(z, starts[i : i + 1].copy(), 50)
        assert np.allclose(params[i], alone[0]) and math.isclose(likelihood[i], value[0])
    # the smoothed probabilities against every path of a short series
    short, p = z[76:84], params[0]
    move, weight = np.array([[p[4], 1 - p[4]], [1 - p[5], p[5]]]), np.zeros((8, 2))
    for path in itertools.product((0, 1), repeat=8):
        chance = 0.5 * np.prod([move[a, b] for a, b in itertools.pairwise(path)])
        chance *= np.prod([math.exp(-((v - p[s]) ** 2) / (2 * p[2 + s])) / math.sqrt(2 * math.pi * p[2 + s]) for v, s in zip(short, path, strict=True)])
        for t, s in enumerate(path):
            weight[t, s] += chance
    smooth, _, total = conditional._forward_backward(short, p[None])
    assert np.allclose(smooth[:, 0], weight / weight.sum(axis=1, keepdims=True)) and math.isclose(total[0], math.log(weight[0].sum()), rel_tol=1e-9)


def test_forest_scores_other_points(spark):
    rows, _ = learner_rows(spark)
    x = ["a", "b", "c"]
    models = learners.grown_forest(rows, ["g"], x, 6, 2, batch=4)
    expected = learners.forest(rows, ["g"], x, 6, 2, "RF", batch=4).where("split = 'test'").toPandas().set_index("day")["y_pred"]
    found = learners.forest_scores(rows.where("split = 'test'"), ["g"], x, models, chunk=30).toPandas().set_index("day")["y_pred"]
    assert len(found) == 100 and np.allclose(found.sort_index(), expected.sort_index())


def test_penalised_fits_minimise_their_objectives(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    y = x @ np.array([1.0, 0.0, -0.5, 0.0]) + rng.normal(size=300)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    cross = np.block([[xc.T @ xc, (xc.T @ yc)[:, None]], [(xc.T @ yc)[None], np.array([[yc @ yc]])]])
    target = {
        "RR": lambda w: ((yc - xc @ w) ** 2).sum() + 3.0 * (w @ w),
        "LA": lambda w: ((yc - xc @ w) ** 2).sum() / 600 + 0.05 * np.abs(w).sum(),
        "EN": lambda w: ((yc - xc @ w) ** 2).sum() / 600 + 0.05 * (0.4 * np.abs(w).sum() + 0.3 * (w @ w)),
    }
    for kind, lam, share in (("RR", 3.0, 1.0), ("LA", 0.05, 1.0), ("EN", 0.05, 0.4)):
        w = linear.PENALISED[kind](cross, 300, lam, share)
        assert all(target[kind](w) <= target[kind](w + d) + 1e-12 for d in 1e-3 * rng.normal(size=(200, 4)))
    lasso = linear.PENALISED["LA"](cross, 300, 0.05, 1.0)
    post = linear.PENALISED["PLA"](cross, 300, 0.05, 1.0)
    on = np.flatnonzero(lasso)
    assert np.allclose(post[on], np.linalg.lstsq(xc[:, on], yc, rcond=None)[0]) and not np.delete(post, on).any()
    size = np.abs(np.linalg.lstsq(xc, yc, rcond=None)[0]) + 1e-12
    adaptive = linear.PENALISED["ALA"](cross, 300, 0.05, 1.0)
    objective = lambda w: ((yc - xc @ w) ** 2).sum() / 600 + 0.05 * (np.abs(w) / size).sum()
    assert all(objective(adaptive) <= objective(adaptive + d) + 1e-12 for d in 1e-3 * rng.normal(size=(200, 4)))


def test_confidence_set_against_plain_elimination(spark):
    """The same draws, eliminated by a plain loop over models."""
    rows = losses.with_losses(frame(spark, models=("A", "B", "C", "D")), ["instrument", "model"])
    placed = inference.placed(rows.select("instrument", "model", "day", F.col("mse").alias("x")), ["instrument", "model"])
    means = inference.bootstrap_means(placed, ["instrument", "model"], ["x"], 300).toPandas().pivot(index="draw", columns="model", values="x_mean")
    actual = rows.groupBy("model").agg(F.avg("mse").alias("m")).toPandas().set_index("model")["m"]
    alive, p, running = list("ABCD"), {}, 0.0
    while len(alive) > 1:
        d = {m: actual[m] - np.mean([actual[k] for k in alive]) for m in alive}
        draws = {m: means[m] - means[alive].mean(axis=1) for m in alive}
        sd = {m: draws[m].std(ddof=1) for m in alive}
        t_max = max(d[m] / sd[m] for m in alive)
        noise = np.max([(draws[m] - d[m]) / sd[m] for m in alive], axis=0)
        running = max(running, float((noise >= t_max).mean()))
        if running > 0.1:
            break
        worst = max(alive, key=lambda m: d[m] / sd[m])
        p[worst] = running
        alive.remove(worst)
    p |= {m: 1.0 if len(alive) == 1 else running for m in alive}
    found = {r.model: (round(r.p_value, 6), r.included) for r in inference.confidence_set(rows, ["instrument"], "mse", 300, (0.1,)).collect()}
    assert found == {m: (round(v, 6), m in alive) for m, v in p.items()}


def test_small_sample_p_values_against_tables():
    for t, df, p in ((1.812, 10, 0.05), (2.228, 10, 0.025), (2.764, 10, 0.01), (2.042, 30, 0.025), (6.314, 1, 0.05), (1.645, 100_000, 0.05)):
        assert math.isclose(tails._t_upper(t, df), p, rel_tol=2e-3)


def test_path_legs_choose_the_best_network(spark):
    rows = losses.with_losses(frame(spark, models=("H", "X", "E", "F", "N1", "N2")), ["instrument", "model"])
    legs = inference.path_legs(rows, ["instrument"], "mse", "H", {"wide": "X", "penalised": "E", "forest": "F"}, ["N2", "N1"])
    assert {r.best for r in legs.select("best").distinct().collect()} == {"N1"}
    assert {r.leg: r.n for r in legs.groupBy("leg").agg(F.count("*").alias("n")).collect()} == {k: 400 for k in ("wide", "penalised", "forest", "network", "total")}
    total = legs.where("leg = 'total'").agg(F.avg("top").alias("top"), F.avg("bottom").alias("bottom")).first()
    want = {r.model: r.m for r in rows.groupBy("model").agg(F.avg("mse").alias("m")).collect()}
    assert math.isclose(total.top, want["N1"], rel_tol=1e-9) and math.isclose(total.bottom, want["H"], rel_tol=1e-9)


def test_model_columns_and_merged_runs(spark):
    rows = frame(spark, 20, ("A",)).drop("model", "y_pred").withColumns({c: F.lit(1.0) for c in [*linear.HAR, "rn_d", "rq_lag", "iv"]})
    assert splits.model_columns(rows, "M_HAR").columns == ["instrument", "day", "split", "y", "rvd", "rvw", "rvm"]
    assert splits.model_columns(rows, "M_ALL").columns == ["instrument", "day", "split", "y", "rvd", "rvw", "rvm", "iv"]
    with pytest.raises(ValueError):
        splits.model_columns(rows.drop("rvw"), "M_HAR")
    store = frame(spark, 20, ("A",)).withColumn("horizon", F.lit(1))
    other = store.withColumn("horizon", F.lit(5)).unionByName(store.withColumn("y_pred", F.lit(7.0)))
    keys = ["instrument", "horizon", "split", "day", "model"]
    assert files.merge_runs([store, other], keys, horizon=1).select(F.sum("y_pred"), F.count("*")).first() == (70.0, 10)
    assert files.merge_runs([store, other], keys, validation=True).count() == 40


def series(spark, x, y, split_at, h=1):
    """One group of rows with regressors x1.., target y, places and splits."""
    n = len(y)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])]).assign(y=y, g="g", horizon=h, day=[DAY0 + dt.timedelta(days=i) for i in range(n)], rn=range(1, n + 1))
    return spark.createDataFrame(pdf).withColumn("split", F.when(F.col("rn") > split_at, "test").otherwise("train"))


def plain_rolling(x, y, split_at, window, refit=1, embargo=0):
    out = []
    for k in range(len(y) - split_at):
        last = split_at + k - k % refit - embargo
        begin = 0 if window is None else max(0, last - window)
        mx, my = x[begin:last].mean(0), y[begin:last].mean()
        b = np.linalg.lstsq(x[begin:last] - mx, y[begin:last] - my, rcond=None)[0]
        out.append(my + (x[split_at + k] - mx) @ b)
    return np.array(out)


@pytest.mark.parametrize(("window", "refit", "embargo"), [("fit", 1, 0), (30, 1, 0), (30, 7, 0), (25, 1, 21), (None, 1, 4), (1000, 1, 0)])
def test_rolling_windows(spark, window, refit, embargo):
    rng = np.random.default_rng(7)
    x = rng.exponential(1, (260, 2))
    y = 1 + x @ np.array([0.5, -0.3]) + rng.normal(0, 0.1, 260)
    found = linear.rolling_forecast(series(spark, x, y, 120), ["g"], ["x0", "x1"], window, refit, embargo).orderBy("day").toPandas()
    assert np.allclose(found["y_pred"], plain_rolling(x, y, 120, 120 if window == "fit" else window, refit, embargo), rtol=1e-9)


def test_rolling_window_forgets_a_level_shift(spark):
    """Levels of 1e8 before row 150: running sums would leave errors of their own size behind."""
    rng = np.random.default_rng(8)
    x = rng.exponential(1, (400, 2))
    y = 1 + x @ np.array([0.5, -0.3]) + rng.normal(0, 0.1, 400)
    x[:150] += 1e8
    y[:150] += 1e8
    found = linear.rolling_forecast(series(spark, x, y, 200), ["g"], ["x0", "x1"], 50).orderBy("day").toPandas()
    assert np.allclose(found["y_pred"], plain_rolling(x, y, 200, 50), rtol=1e-9)


def test_embargo_depends_on_the_horizon(spark):
    rng = np.random.default_rng(9)
    x = rng.exponential(1, (120, 1))
    y = x[:, 0] + rng.normal(0, 0.1, 120)
    both = series(spark, x, y, 80).unionByName(series(spark, x, y, 80, 5))
    found = linear.rolling_forecast(both, ["g", "horizon"], ["x0"], 40, embargo=F.col("horizon") - 1).orderBy("horizon", "day").toPandas()
    for h in (1, 5):
        assert np.allclose(found["y_pred"][found["horizon"] == h], plain_rolling(x, y, 80, 40, embargo=h - 1), rtol=1e-9)


def test_har_family_clip_logs_and_fixed_fit(spark):
    rng = np.random.default_rng(10)
    x = rng.exponential(1, (200, 3))
    y = np.exp(0.2 * np.log(x).sum(1) + rng.normal(0, 0.1, 200))
    x[150] *= 1000  # the forecast of that day would leave the window's range
    rows = series(spark, x, y, 100).withColumnsRenamed({"x0": "rvd", "x1": "rvw", "x2": "rvm"}).withColumn("rq_x_rv", F.col("rvd") * F.col("rvw"))
    models = {"HAR": linear.HAR, "LogHAR": linear.HAR, "HARQ": [*linear.HAR, "rq_x_rv"]}
    found = linear.rolling_models(rows, ["g"], models).toPandas().pivot(index="day", columns="model", values="y_pred").sort_index()
    z = np.column_stack([x, x[:, 0] * x[:, 1]])
    clipped = [min(max(p, y[k : k + 100].min()), y[k : k + 100].max()) for k, p in enumerate(plain_rolling(z, y, 100, 100))]
    assert np.allclose(found["HARQ"], clipped, rtol=1e-6) and found["HARQ"].iloc[50] in (y[50:150].min(), y[50:150].max())
    a = np.column_stack([np.ones(100), np.log(x[30:130])])
    b, left = np.linalg.lstsq(a, np.log(y[30:130]), rcond=None)[:2]
    assert math.isclose(found["LogHAR"].iloc[30], math.exp(b @ [1, *np.log(x[130])] + left[0] / 96 / 2), rel_tol=1e-8)
    # fixed: the first test day has the window that all train and val rows are
    fixed = linear.fixed_models(rows, ["g"], models).where("split = 'test'").toPandas().pivot(index="day", columns="model", values="y_pred").sort_index()
    assert np.allclose(fixed.iloc[0], found.iloc[0], rtol=1e-9) and not np.allclose(fixed.iloc[60], found.iloc[60], rtol=1e-9)


def test_rolling_median_against_plain_windows():
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, 200)
    x[rng.integers(0, 200, 30)] = np.nan
    found = B.rolling_median(x, 25, 24, 10)
    for i in range(200):
        own = x[max(0, i - 25) : i + 25]
        own = own[~np.isnan(own)]
        assert np.isclose(found[i], np.median(own)) if len(own) >= 10 else np.isnan(found[i])
    assert len(B.rolling_median(np.array([]), 25, 24, 10)) == 0


def test_flags_carry_rows_and_days(spark):
    at = lambda day, m: dt.datetime(2020, 1, day, 9, 30) + dt.timedelta(minutes=m)
    rows = [("X", at(2, 0), 1.0, "a"), ("X", at(2, 1), 2.0, "b"), ("X", at(3, 0), 9.0, "c"), ("X", at(3, 1), None, "d"), ("X", at(3, 2), 9.0, None), ("X", at(3, 3), 0.0, "f"), ("Y", at(2, 0), 5.0, "g")]
    bars = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, close double, `bar note` string")
    for size in (2, 200_000):
        found = B.outlier_flags(bars, bucket_rows=size).orderBy("instrument", "ts").collect()
        # a step over a day's end, beside a missing price or to a price of 0 is no jump
        assert [r.jumped for r in found] == [False, True, False, False, False, False, False] and not any(r.outlier for r in found)
        assert [r["bar note"] for r in found] == ["a", "b", "c", "d", None, "f", "g"]
