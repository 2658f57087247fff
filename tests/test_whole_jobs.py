"""Explanation and rolling queries run to their end and on all of their rows."""

import datetime
import math

import numpy as np
import pytest
from test_properties import learner_rows

from tidemark.operators import explain, learners, linear
from tidemark.plans import base, models

X = ["a", "b", "c"]


def test_importance_grid_of_all_models(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(models, "TREES", 20)
    found = models.m3(spark, sf_dir).collect()
    sizes = {(r.instrument, r.model): len([1 for o in found if (o.instrument, o.model) == (r.instrument, r.model)]) for r in found}
    assert {m for _, m in sizes} == {"RF", "HAR", "LevHAR"}
    assert all(n == (6 if m == "LevHAR" else 3) for (_, m), n in sizes.items())
    rows = base.split_features(spark, sf_dir, [1])
    fits = linear.ols(rows.where("split <> 'test'"), models.KEYS, models.HAR).collect()
    for fit in fits:
        test = rows.where((rows.split == "test") & (rows.instrument == fit.instrument))
        rule = explain.by_column(lambda v, b=fit.beta: sum(w * v[c] for w, c in zip(b, models.HAR, strict=True)), models.HAR)
        effects = explain.all_effects(test, models.KEYS, rule, models.HAR, models.BINS)
        for r in explain.importance(effects, models.KEYS).collect():
            (own,) = [o.vi for o in found if (o.instrument, o.model, o.feature) == (r.instrument, "HAR", r.feature)]
            assert math.isclose(own, r.vi, rel_tol=1e-9)


def test_shapley_shares_of_all_test_rows(spark):
    first = datetime.date(2020, 1, 1)
    rows = [("A", 1, first + datetime.timedelta(i), "train" if i < 20 else "test", float(i % 7), float(i % 5), 8.0 * (i >= 320)) for i in range(330)]
    df = spark.createDataFrame(rows, "instrument string, horizon int, day date, split string, rvd double, rvw double, rvm double")
    found = {r.feature: r.share for r in models.shares(df.where("split = 'train'"), df.where("split = 'test'"), models.RULE).collect()}
    sizes = {}
    for at, c in enumerate(models.HAR, 4):
        mean = sum(r[at] for r in rows[:20]) / 20
        sizes[c] = sum(abs(models.WEIGHTS[c] * (r[at] - mean)) for r in rows[20:]) / 310
    assert all(math.isclose(found[c], sizes[c] / sum(sizes.values()), rel_tol=1e-9) for c in models.HAR)
    assert models.first_rows(df.where("split = 'test'")).count() == 300


def test_rolling_trees_are_refitted_for_each_test_row(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(models, "TREES", 4)
    monkeypatch.setattr(models, "ROUNDS", [5, 10])
    found = {(r.instrument, r.scheme): (r.value, r.ratio) for r in models.g26(spark, sf_dir).where("model = 'GB'").collect()}
    rows = base.split_features(spark, sf_dir, [1])
    settings = {r.instrument: r for r in learners.tuned_boosting(rows, models.KEYS, models.HAR, [5, 10], [0.01, 0.1], [1, 2]).collect()}
    for name, pdf in rows.toPandas().sort_values("day").groupby("instrument"):
        x, y, many = pdf[models.HAR].to_numpy(), pdf["y"].to_numpy(), int((pdf["split"] != "test").sum())
        least, own, errors = y[pdf["split"] == "train"].min(), settings[name], []
        for i in range(many, len(y)):
            fitted = np.append(y[i - many : i], np.nan)
            *_, last = learners._boost(x[i - many : i + 1], fitted, own.size, own.rate, own.depth, 42)
            errors.append((y[i] - max(last[-1], least if least > 0 else 1e-12)) ** 2)
        assert len(errors) > 2 and math.isclose(found[name, "rolling"][0], np.mean(errors), rel_tol=1e-9)
        fixed = found[name, "fixed"]
        assert math.isclose(found[name, "rolling"][1] / found[name, "rolling"][0], fixed[1] / fixed[0], rel_tol=1e-9)


@pytest.mark.parametrize("fits", [8, 30, 1000])
def test_windows_end_right_before_their_row(spark, monkeypatch, fits):
    monkeypatch.setattr(learners, "FITS", fits)
    rows, y = learner_rows(spark)
    made = learners.rolling(rows, ["g"], X, lambda x, y, ask, place, setting: float(y.sum() + 1000 * place + ask[0]), "M").toPandas().sort_values("day")
    first = rows.toPandas().sort_values("day")["a"].to_numpy()
    assert len(made) == 100 and set(made["split"]) == {"test"} and np.allclose(made["y"], y[300:])
    assert np.allclose(made["y_pred"], [y[i - 300 : i].sum() + 1000 * (i - 300) + first[i] for i in range(300, 400)])


def test_one_answer_is_that_of_the_whole_tree():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 3)), rng.normal(size=300)
    drawn = rng.integers(0, 300, (7, 300))
    trees = [learners.grow(x[d], y[d], rng, 3, 5) for d in drawn]
    for ask in rng.normal(size=(20, 3)):
        whole = [learners.fall(t, ask[None])[0] for t in trees]
        assert np.allclose(learners.answers(x, y, ask, drawn, rng, 3, 5), whole, rtol=1e-12)
    # each row once, and a tree grown to the end: it says the row's own target, whatever features are tried
    every = np.arange(300)[None]
    assert all(learners.answers(x, y, x[i], every, rng, 1, 1000)[0] == y[i] for i in range(20))
    assert learners.answers(np.ones((5, 3)), y[:5], x[0], np.arange(5)[None], rng, 3, 1000)[0] == pytest.approx(y[:5].mean())


def test_rolling_forest_agrees_with_forests_of_its_windows(spark):
    rows, _ = learner_rows(spark)
    made = learners.rolling_forest(rows, ["g"], X, 60, 2, "RF").toPandas().sort_values("day")
    pdf = rows.toPandas().sort_values("day")
    x, y = pdf[X].to_numpy(), pdf["y"].to_numpy()
    for i in (300, 350, 399):
        own = []
        for k in range(200):
            rng = np.random.default_rng((9, k))
            d = rng.integers(0, 300, 300) + i - 300
            own.append(learners.fall(learners.grow(x[d], y[d], rng, 2, 1000), x[i : i + 1])[0])
        assert abs(made["y_pred"].to_numpy()[i - 300] - np.mean(own)) < 5 * np.std(own) / 60**0.5 + 1e-9
    assert set(made["model"]) == {"RF"}
