"""Steps that the tree, network and effect queries share take one exchange, one job or one pass."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_properties import learner_rows

from tidemark.operators import explain, learners
from tidemark.plans import base, models  # noqa: F401

X = ["a", "b", "c"]


def test_returns_take_one_exchange(spark, sf_dir):
    plan = base.returns(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sorted_columns_can_be_given():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 3)).round(1), rng.normal(size=200)
    grown = [learners.grow(x, y, np.random.default_rng(1), 2, 1000, by_value=b) for b in (None, learners._by_value(x))]
    assert all(np.array_equal(a, b) for a, b in zip(*grown, strict=True))
    small = learners._compact(grown[0])
    assert np.array_equal(learners.fall(small, x), learners.fall(grown[0], x)) and len(pickle.dumps(small)) < 0.6 * len(pickle.dumps(grown[0]))


def test_architectures_are_fitted_together(spark):
    rows, _ = learner_rows(spark)
    both = learners.networks(rows, ["g"], X, ["NN1", "NN2"], 3, 20, 2).toPandas()
    for name in ("NN1", "NN2"):
        one = learners.networks(rows, ["g"], X, name, 3, 20, 2).toPandas().sort_values(["model", "day"])
        found = both[both["model"].str.startswith(name)].sort_values(["model", "day"])
        assert list(found["model"]) == list(one["model"]) and np.allclose(found["y_pred"], one["y_pred"])


def test_effects_score_all_features_at_once(spark):
    rows, _ = learner_rows(spark)
    asked, rule = [], explain.by_column(lambda v: v["a"] + 2 * v["b"], X)
    found = explain.all_effects(rows, ["g"], lambda points: asked.append(1) or rule(points), X, 10)
    assert len(asked) == 1 and found.select("feature").distinct().count() == 3


@pytest.mark.parametrize("few", [0, 16])
def test_points_meet_models_either_way(spark, monkeypatch, few):
    rows, _ = learner_rows(spark)
    monkeypatch.setattr(learners, "FEW_CHUNKS", few)
    grown = learners.grown_forest(rows, ["g"], X, 6, 2, batch=4)
    expected = learners.forest(rows, ["g"], X, 6, 2, "RF", batch=4).where("split = 'test'").toPandas().sort_values("day")
    found = learners.forest_scores(rows.where(F.col("split") == "test"), ["g"], X, grown, chunk=30).toPandas().sort_values("day")
    assert np.allclose(found["y_pred"], expected["y_pred"])
