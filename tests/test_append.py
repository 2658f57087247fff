"""Days that come later give what a build of everything gives."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import append, features
from tidemark.operators import bars as B
from tidemark.operators import measures as D


@pytest.fixture(scope="module")
def ticks(spark):
    rng, rows = random.Random(1), []
    for name in ("A", "B"):
        for day in range(1, 13):
            for m in range(rng.choice([3, 20, 60])):
                price = 100 * (1 + 0.001 * rng.random()) * (1.5 if rng.random() < 0.05 else 1)
                rows.append((name, dt.datetime(2024, 1, day, 9, 0) + dt.timedelta(minutes=5 * m, seconds=rng.randint(0, 50)), price, 1.0))
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, close double, volume double")


def told(df):
    return sorted((r.instrument, str(r.day), r.n_returns, round(r.rv, 9), round(r.volume, 6)) for r in df.collect())


@pytest.mark.parametrize("ends", [[6], [2, 3, 4, 11]])
def test_appended_bars(ticks, ends):
    hours = {"opens": "09:15:00", "closes": "13:00:00"}
    full = D.daily_measures(B.clean_bars(ticks, jump=0.2, spread=3.0, **hours), 15)
    state, out = B.session_filter(ticks.limit(0), **hours).withColumn("open", F.lit(True)), None
    for a, b in zip([0, *ends], [*ends, 31], strict=True):
        rows, days, state = append.append_bars(state, ticks.where((F.dayofmonth("ts") > a) & (F.dayofmonth("ts") <= b)), 15, jump=0.2, spread=3.0, **hours)
        out = rows if out is None else append.replaced(out, rows, days)
    assert told(out) == told(full)
    # the state has the open days and a window's reach before them, not the history
    assert state.count() <= 2 * (48 + 50 + 2 * 60)
    # an append without bars judges the open days again, to the same end
    rows, days, again = append.append_bars(state, ticks.limit(0), 15, jump=0.2, spread=3.0, **hours)
    assert told(append.replaced(out, rows, days)) == told(full) and again.count() == state.count()


@pytest.mark.parametrize("ends", [[40], [3, 4, 5, 30, 59]])
def test_appended_days(spark, ends):
    rng = random.Random(2)
    rows = [(n, dt.date(2024, 1, 1) + dt.timedelta(days=d), rng.random(), rng.random(), rng.random(), rng.random(), rng.gauss(0, 1), 1.0 + rng.random(), 5.0) for n in "AB" for d in range(60) if n == "A" or d > 20]
    daily = spark.createDataFrame(rows, "instrument string, day date, rv double, rv_pos double, rv_neg double, rq double, ret double, volume double, price double")
    horizons, at = [1, 5, 22], F.datediff("day", F.lit("2024-01-01"))
    full = features.build(daily, horizons)
    state, out = daily.limit(0), None
    for a, b in zip([-1, *ends], [*ends, 99], strict=True):
        rows, state = append.append_days(state, daily.where((at > a) & (at <= b)), horizons)
        out = rows if out is None else out.unionByName(rows)
    assert sorted(map(str, out.collect())) == sorted(map(str, full.collect()))
    assert state.groupBy("instrument").count().where("count > 44").isEmpty()
