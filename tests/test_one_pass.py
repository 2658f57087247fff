"""Plans read the trades once; the rest reads the kept daily panel."""

import pytest

from tidemark.plans import base, models  # noqa: F401


def test_daily_panel_is_kept(spark, sf_dir):
    for made in (base.daily(spark, sf_dir), base.split_features(spark, sf_dir), base.split_features(spark, sf_dir, [1], wide=True)):
        assert "lineitem.parquet" not in made._jdf.queryExecution().toString()
    days = base.daily(spark, sf_dir)
    assert days.count() == days.where("volume > 0 and price > 0").count() > 0


@pytest.mark.parametrize("name", ["g08_standardise", "g14_selected_penalties", "g23_linear_panel", "g24_date_split_run", "m06_shapley_linear_rule", "m07_compared_linear_rule"])
def test_trades_are_read_once(spark, sf_dir, monkeypatch, name):
    read, trades = [], base.views.trades
    monkeypatch.setattr(base.views, "trades", lambda s, d: read.append(d) or trades(s, d))
    made = base.QUERIES[name](spark, sf_dir)
    assert len(read) == 1
    assert "lineitem.parquet" not in made._jdf.queryExecution().toString()


def test_features_of_a_given_panel(spark, sf_dir):
    days = base.daily(spark, sf_dir)
    assert sorted(base.features(spark, sf_dir, [1], panel=days).collect()) == sorted(base.features(spark, sf_dir, [1]).collect())
