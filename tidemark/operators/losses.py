"""Forecast losses over the long table (instrument, day, model, y, y_pred) and loss tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSSES = ("mse", "mae", "qlike")
FAMILIES = {
    "HAR": ["HAR", "LogHAR", "LevHAR", "SHAR", "HARQ", "HAR-X"],
    "REG": ["RR", "LA", "EN", "PLA", "ALA"],
    "TREE": ["BG", "RF", "GB"],
    "NN": ["NN1", "NN2", "NN3", "NN4"],
}


def squared(y: Column, p: Column) -> Column:
    return (y - p) * (y - p)


def absolute(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def qlike(y: Column, p: Column, floor: Column) -> Column:
    ratio = F.greatest(y, floor) / F.greatest(p, floor)
    return ratio - F.log(ratio) - 1


def qlike_floor(y: Column) -> Column:
    """Aggregate: the floor of a slice, from its least positive target."""
    return F.greatest(F.lit(1e-12), 1e-3 * F.coalesce(F.min(F.when(y > 0, y)), F.lit(0.0)))


def with_losses(forecasts: DataFrame, slice_by: list[str]) -> DataFrame:
    """Add ``mse``, ``mae``, ``qlike``; the floor of the last is that of the row's slice."""
    y, p = F.col("y"), F.col("y_pred")
    floor = F.greatest(F.lit(1e-12), 1e-3 * F.coalesce(F.min(F.when(y > 0, y)).over(Window.partitionBy(*slice_by)), F.lit(0.0)))
    return forecasts.withColumn("floor", floor).withColumns({"mse": squared(y, p), "mae": absolute(y, p), "qlike": qlike(y, p, F.col("floor"))}).drop("floor")


def mean_losses(forecasts: DataFrame, by: list[str], loss: str | None = None) -> DataFrame:
    """(*by, loss, value): mean loss per group, the group being the slice."""
    if loss is not None and loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}")
    y, p = F.col("y"), F.col("y_pred")
    floors = forecasts.groupBy(*by).agg(qlike_floor(y).alias("floor"))
    rows = forecasts.join(floors, by)
    means = rows.groupBy(*by).agg(F.avg(squared(y, p)).alias("mse"), F.avg(absolute(y, p)).alias("mae"), F.avg(qlike(y, p, F.col("floor"))).alias("qlike"))
    long = means.unpivot(by, list(LOSSES), "loss", "value")
    return long if loss is None else long.where(F.col("loss") == loss)


def ratios(table: DataFrame, baseline: str, by: list[str]) -> DataFrame:
    """Add ``ratio`` to the baseline model within ``by``."""
    base = F.max(F.when(F.col("model") == baseline, F.col("value"))).over(Window.partitionBy(*by))
    return table.withColumn("ratio", F.col("value") / base)


def across(ratio_table: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and five-number summary of ratios over instruments."""
    five = F.percentile("ratio", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return ratio_table.groupBy(*by).agg(F.avg("ratio").alias("mean_ratio"), F.median("ratio").alias("median_ratio"), five.alias("q")).select(
        *by, "mean_ratio", "median_ratio", *[F.col("q")[i].alias(n) for i, n in enumerate(("least", "q25", "q50", "q75", "most"))]
    )


def winners(ratio_table: DataFrame, by: list[str], decimals: int = 3) -> DataFrame:
    """Rounded ratios with ``best`` on the least of each group (first by name on ties)."""
    best = F.min_by("model", F.struct("ratio", "model")).over(Window.partitionBy(*by))
    return ratio_table.withColumn("best", F.col("model") == best).withColumn("ratio", F.round("ratio", decimals))


def family(model: Column) -> Column:
    out = None
    for name, models in FAMILIES.items():
        hit = model.isin(models) | F.lit(name == "NN") & model.startswith("NN")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("OLS")


def path_decomposition(ratio_table: DataFrame, by: list[str], har_x: str, penalised: str, forest: str, networks: list[str]) -> DataFrame:
    """Percentage points that each step of the model path adds or takes."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("ratio")))
    row = ratio_table.groupBy(*by).agg(of(har_x).alias("x"), of(penalised).alias("p"), of(forest).alias("f"), F.min(F.when(F.col("model").isin(networks), F.col("ratio"))).alias("nn"))
    x, p, f, nn = (F.col(c) for c in ("x", "p", "f", "nn"))
    legs = {"overfit": x - 1, "penalty_gain": 1 - p, "forest_marginal": p - f, "network_marginal": f - nn, "total": 1 - nn}
    share = F.when(nn < 1, (1 - p) / (1 - nn))
    return row.select(*by, *[(100 * c).alias(n) for n, c in legs.items()], share.alias("penalty_share"))


def best_edge(ratio_table: DataFrame, by: list[str], baseline: str) -> DataFrame:
    """Largest gain of any other model over the baseline, in per cent, not below zero."""
    least = F.min(F.when(F.col("model") != baseline, F.col("ratio")))
    return ratio_table.groupBy(*by).agg(F.greatest((1 - least) * 100, F.lit(0.0)).alias("edge"))
