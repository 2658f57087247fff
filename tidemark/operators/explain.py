"""Accumulated local effects, sampled Shapley shares and their comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Score = Callable[[dict[str, Column]], Column]
#: Adds ``y_pred`` to a table with the keys and feature columns.
Predict = Callable[[DataFrame], DataFrame]


def by_column(score: Score, features: list[str]) -> Predict:
    """Scoring by a column expression."""
    return lambda points: points.withColumn("y_pred", score({c: F.col(c) for c in features}))


def _binned(rows: DataFrame, keys: list[str], feature: str, bins: int) -> tuple[DataFrame, DataFrame]:
    """The bins of a feature, and the rows twice: at the low (``end`` 0) and the high edge of their bin."""
    q = [F.lit(i / bins) for i in range(bins + 1)]
    edges = rows.groupBy(*keys).agg(F.percentile(feature, F.array(*q)).alias("q"), F.sort_array(F.collect_set(feature)).alias("values"))
    two = F.array(F.col("values")[0], F.get("values", F.lit(1)))
    cut = F.array_distinct("q")
    edges = edges.select(*keys, F.when(F.size(cut) >= 3, cut).when(F.size("values") == 2, two).alias("edges")).where("edges is not null")
    inner = F.slice(F.col("edges"), F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    placed = rows.join(edges, keys).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(feature))) + 1)
    ends = placed.withColumn("end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(feature, F.element_at("edges", F.col("bin") + F.col("end")))
    every = edges.select(*keys, F.lit(feature).alias("_feature"), "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    return every, ends.drop("edges").withColumn("_feature", F.lit(feature))


def local_effects(rows: DataFrame, keys: list[str], feature: str, predict: Predict, features: list[str], bins: int = 40) -> DataFrame:
    """``all_effects`` of one feature."""
    return all_effects(rows, keys, predict, [feature], bins)


def all_effects(rows: DataFrame, keys: list[str], predict: Predict, features: list[str], bins: int = 40) -> DataFrame:
    """(keys, feature, bin, low, high, ale, n): mean change of the prediction across each quantile bin,
    summed up and centred by the bins' counts. Empty bins add nothing but keep their place. A
    two-valued feature has one bin; groups with fewer values are left out. Both ends of a row's bin
    are scored, for all features in one pass."""
    every, ends = (reduce(DataFrame.unionByName, both) for both in zip(*[_binned(rows, keys, f, bins) for f in features], strict=True))
    change = F.sum(F.when(F.col("end") == 1, F.col("y_pred")).otherwise(-F.col("y_pred")))
    n = F.sum("end")
    run = [*keys, "_feature"]
    found = predict(ends).groupBy(*run, "bin").agg((change / n).alias("effect"), n.alias("n"))
    table = every.join(found, [*run, "bin"], "left").select(
        *run, "bin", F.element_at("edges", F.col("bin")).alias("low"), F.element_at("edges", F.col("bin") + 1).alias("high"),
        F.coalesce("effect", F.lit(0.0)).alias("effect"), F.coalesce("n", F.lit(0)).alias("n"),
    )
    w = Window.partitionBy(*run)
    table = table.withColumn("total", F.sum("effect").over(w.orderBy("bin")))
    centre = F.sum(F.col("total") * F.col("n")).over(w) / F.sum("n").over(w)
    return table.select(*keys, F.col("_feature").alias("feature"), "bin", "low", "high", (F.col("total") - centre).alias("ale"), "n")


def importance(effects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, vi): root mean square effect, as shares that sum to one."""
    raw = effects.groupBy(*keys, "feature").agg(F.sqrt(F.sum(F.col("ale") * F.col("ale") * F.col("n")) / F.sum("n")).alias("raw"))
    return raw.select(*keys, "feature", (F.col("raw") / F.sum("raw").over(Window.partitionBy(*keys))).alias("vi"))


def shapley_shares(rows: DataFrame, keys: list[str], predict: Predict, features: list[str], background: DataFrame, orders: int = 16) -> DataFrame:
    """(keys, feature, share): mean absolute sampled Shapley value, as shares. Each row meets
    ``orders`` feature orders (keyed shuffles); its features are put in place one after the other, and
    those not yet reached have the group's background mean. All points are scored in one pass."""
    means = background.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in features])
    p = len(features)
    shuffled = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(i), F.col("order")).alias("h"), F.lit(c).alias("feature")) for i, c in enumerate(features)]))
    placed = rows.select(*keys, "day", *features).join(means, keys).withColumn("order", F.explode(F.sequence(F.lit(1), F.lit(orders))))
    placed = placed.withColumn("names", F.transform(shuffled, lambda x: x.feature)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(p))))
    reached = {c: F.when(F.array_position("names", c) <= F.col("k"), F.col(c)).otherwise(F.col(f"m_{c}")) for c in features}
    points = placed.select(*keys, "day", "order", "k", F.get("names", F.col("k") - 1).alias("feature"), *[v.alias(c) for c, v in reached.items()])
    before = F.lag("y_pred").over(Window.partitionBy(*keys, "day", "order").orderBy("k"))
    gains = predict(points).withColumn("gain", F.col("y_pred") - before).where("k > 0")
    per_row = gains.groupBy(*keys, "day", "feature").agg(F.avg("gain").alias("phi"))
    size = per_row.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("size"))
    return size.select(*keys, "feature", (F.col("size") / F.sum("size").over(Window.partitionBy(*keys))).alias("share"))


def compared(importances: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spearman, top_vi, top_share): rank correlation with average ranks for ties."""
    rows = importances.join(shares, [*keys, "feature"])
    w = Window.partitionBy(*keys)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
    rows = rows.withColumn("ra", rank("vi")).withColumn("rb", rank("share"))
    return rows.groupBy(*keys).agg(F.corr("ra", "rb").alias("spearman"), F.max_by("feature", F.struct("vi", "feature")).alias("top_vi"), F.max_by("feature", F.struct("share", "feature")).alias("top_share"))
