"""A regressor that never changes in a fit adds nothing: forecasts are those without it."""

import datetime

import numpy as np

from tidemark.operators import linear


def test_constant_regressor_adds_nothing(spark):
    rng, first = np.random.default_rng(5), datetime.date(2020, 1, 1)
    rows = [("A", 1, first + datetime.timedelta(i), i + 1, "train" if i < 70 else "val" if i < 80 else "test", *map(float, rng.normal(size=3)), 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "instrument string, horizon int, day date, rn int, split string, a double, b double, y double, event double")
    keys = ["instrument", "horizon"]
    for made in (
        lambda x: linear.forecast(df.where("split <> 'test'"), df.where("split = 'test'"), keys, "M", x),
        lambda x: linear.rolling_models(df, keys, {"M": x}),
        lambda x: linear.fixed_models(df, keys, {"M": x}),
    ):
        with_it, without = ({r.day: r.y_pred for r in made(x).collect()} for x in (["a", "b", "event"], ["a", "b"]))
        assert with_it.keys() == without.keys()
        assert len(with_it) >= 20
        assert all(abs(with_it[k] - without[k]) < 1e-9 for k in with_it)
