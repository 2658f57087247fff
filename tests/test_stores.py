"""Layers, the store of runs, and as-of joins of two large sides."""

from __future__ import annotations

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.session import SETTINGS
from tidemark.sources import files, runs
from tidemark.storage import new_path

RUN = "feature_set string, horizon int, split string, model string, instrument string, day date, y_pred double"


def run_rows(spark, models, value, days=5, horizon=1):
    rows = [("M", horizon, "test", m, i, dt.date(2020, 1, 1 + k), float(value)) for m in models for i in ("A", "B") for k in range(days)]
    return spark.createDataFrame(rows, RUN)


def told(df):
    return {(r.model, r.horizon): (r.n, r.v) for r in df.groupBy("model", "horizon").agg(F.count("*").alias("n"), F.avg("y_pred").alias("v")).collect()}


def test_a_repeated_run_replaces_its_keys(spark):
    path = new_path(spark, "runs")
    assert runs.latest(spark, path) == 0
    with pytest.raises(ValueError, match="no runs"):
        runs.read(spark, path)
    assert runs.commit(run_rows(spark, ["HAR", "RF"], 1), path) == 1
    assert runs.commit(run_rows(spark, ["RF"], 2, days=3), path) == 2
    # fewer days replace all days of the key; other keys and horizons stay
    assert runs.commit(run_rows(spark, ["RF"], 5, horizon=5), path) == 3
    assert told(runs.read(spark, path)) == {("HAR", 1): (10, 1.0), ("RF", 1): (6, 2.0), ("RF", 5): (10, 5.0)}
    assert told(runs.read(spark, path, version=1)) == {("HAR", 1): (10, 1.0), ("RF", 1): (10, 1.0)}
    assert told(runs.read(spark, path, model="RF", horizon=1)) == {("RF", 1): (6, 2.0)}
    assert runs.read(spark, path, model="none").count() == 0
    # a run without rows changes nothing; what no reader needs can go
    assert runs.commit(run_rows(spark, ["RF"], 9).limit(0), path) == 3
    before = told(runs.read(spark, path))
    runs.commit(run_rows(spark, ["HAR"], 1), path)
    assert runs.vacuum(spark, path) == 2  # the empty run and the first one, of which no key is left
    assert told(runs.read(spark, path)) == before


def test_a_failed_run_leaves_nothing(spark):
    path = new_path(spark, "runs")
    runs.commit(run_rows(spark, ["HAR"], 1), path)
    broken = run_rows(spark, ["HAR"], 2).repartition(3).withColumn("y_pred", F.when(F.col("day") == "2020-01-03", F.raise_error(F.lit("lost"))).otherwise(F.col("y_pred")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        runs.commit(broken, path)
    # rows that were written without a commit, as by a writer that ended in between
    run_rows(spark, ["HAR"], 3).write.parquet(f"{path}/data/run={uuid.uuid4().hex}")
    assert told(runs.read(spark, path)) == {("HAR", 1): (10, 1.0)} and runs.latest(spark, path) == 1
    assert runs.vacuum(spark, path) >= 1 and told(runs.read(spark, path)) == {("HAR", 1): (10, 1.0)}


def test_a_reader_during_a_write_and_two_writers(spark, monkeypatch):
    path = new_path(spark, "runs")
    runs.commit(run_rows(spark, ["HAR"], 1), path)
    reader = runs.read(spark, path)
    latest = runs.latest
    monkeypatch.setattr(runs, "latest", lambda s, p: 0 if not seen.append(1) and len(seen) == 1 else latest(s, p))
    seen = []
    assert runs.commit(run_rows(spark, ["HAR"], 2), path) == 2 and len(seen) == 2  # the first number was taken
    assert told(reader) == {("HAR", 1): (10, 1.0)} and told(runs.read(spark, path)) == {("HAR", 1): (10, 2.0)}


def test_a_hot_key_is_written_by_several_tasks(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("s"), F.col("id") % 3)).otherwise("hot").alias("instrument"), F.date_add(F.lit("2000-01-01"), (F.col("id") % 5000).cast("int")).alias("day"), F.rand(3).alias("x"))
    path = new_path(spark, "layer")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few bytes are one task's
    try:
        files.write_layer(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    back = files.read_layer(spark, path)
    assert back.select("instrument", "day", "x").exceptAll(rows).isEmpty() and back.count() == 200_000
    spread = back.where("instrument = 'hot'").groupBy(F.input_file_name().alias("f")).agg(F.min("day").alias("a"), F.max("day").alias("b")).orderBy("a").collect()
    assert len(spread) >= 3 and all(p.b <= q.a for p, q in zip(spread, spread[1:], strict=False))


def test_bucketed_tables_need_no_exchange(spark):
    rows = spark.range(3000).select(F.concat(F.lit("i"), F.col("id") % 30).alias("instrument"), F.date_add(F.lit("2000-01-01"), (F.col("id") / 30).cast("int")).alias("day"), F.col("id").alias("x"))
    path = new_path(spark, "buckets")
    name = f"t_{uuid.uuid4().hex}"
    left, right = (files.write_bucketed(rows.withColumnRenamed("x", c), f"{name}_{c}", f"{path}-{c}", buckets=4) for c in ("a", "b"))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", SETTINGS["spark.sql.requireAllClusterKeysForCoPartition"])
    joined = left.withColumn("before", F.expr("lag(a) over (partition by instrument order by day)")).join(right.hint("merge"), ["instrument", "day"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert not re.search(r"\bExchange\b", plan)
    assert joined.where("a = b and (before = a - 30 or day = '2000-01-01')").count() == 3000


def plain_asof(left, right):
    out = []
    for k, t, x in left:
        past = [(rt is not None, rt or 0, v) for rk, rt, v in right if rk == k and (rt is None or (t is not None and rt <= t))]
        out.append((k, t, x, max(past)[2] if past else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("tasks", [1, 4, 13])
def test_asof_of_two_large_sides(spark, tasks):
    rng = random.Random(tasks)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    left = [(key(), rng.choice([None, *range(300)]), i) for i in range(500)] + [("only left", 5, -1)]
    right = {(key(), rng.choice([None, *range(300)])): None for _ in range(200)} | {("only right", 5): None}
    right = [(k, t, i) for i, (k, t) in enumerate(right)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        a = spark.createDataFrame(left, "k string, t int, `x y` int")
        b = spark.createDataFrame(right, "k string, t int, v int")
        found = features.asof_ranges(a, b, "t", ("k",)).collect()
        assert sorted((tuple(r) for r in found), key=str) == plain_asof(left, right)
        flat = [(None, t, x) for _, t, x in left]
        one = {t: v for _, t, v in right}
        found = features.asof_ranges(a.drop("k"), spark.createDataFrame(list(one.items()), "t int, v int"), "t").collect()
        assert sorted(((None, *r) for r in found), key=str) == plain_asof(flat, [(None, t, v) for t, v in one.items()])
        assert features.asof_ranges(a, b.limit(0), "t", ("k",)).where("v is null").count() == len(left)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="x y"):
        features.asof_ranges(a, b.withColumn("x y", F.lit(1)), "t", ("k",))
