"""Lag, horizon and calendar features of the daily table (instrument, day, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.storage import cut


def by_day() -> WindowSpec:
    """An instrument's rows in order of day."""
    return Window.partitionBy("instrument").orderBy("day")


def full_mean(c: Column, first: int, last: int) -> Column:
    """Mean over rows first..last around the current one; null unless all are there."""
    frame = by_day().rowsBetween(first, last)
    return F.when(F.count(c).over(frame) == last - first + 1, F.avg(c).over(frame))


def full_sum(c: Column, first: int, last: int) -> Column:
    frame = by_day().rowsBetween(first, last)
    return F.when(F.count(c).over(frame) == last - first + 1, F.sum(c).over(frame))


def har_lags(rv: str = "rv") -> dict[str, Column]:
    c = F.col(rv)
    return {"rvd": F.lag(c, 1).over(by_day()), "rvw": full_mean(c, -5, -1), "rvm": full_mean(c, -22, -1)}


def semivariance_lags() -> dict[str, Column]:
    return {"rvd_pos": F.lag("rv_pos").over(by_day()), "rvd_neg": F.lag("rv_neg").over(by_day())}


def negative_return_lags(ret: str = "ret") -> dict[str, Column]:
    low = F.when(F.col(ret) < 0, F.col(ret)).otherwise(0.0)
    return {"rn_d": F.lag(low).over(by_day()), "rn_w": full_mean(low, -5, -1), "rn_m": full_mean(low, -22, -1)}


def quarticity_terms() -> dict[str, Column]:
    rq = F.lag("rq").over(by_day())
    return {"rq_x_rv": F.sqrt(F.greatest(rq, F.lit(0.0))) * F.lag("rv").over(by_day()), "rq_lag": rq}


def target(horizon: int, rv: str = "rv") -> Column:
    """Mean of this row and the next ``horizon - 1``; null unless all are there."""
    return full_mean(F.col(rv), 0, horizon - 1)


def momentum() -> Column:
    """Sum of the last five returns, one row back."""
    return full_sum(F.col("ret"), -5, -1)


def dollar_volume_change() -> Column:
    """Change of log (price * volume), one row back; zero counts as missing."""
    dollar = F.log(F.nullif(F.col("price") * F.col("volume"), F.lit(0.0)))
    return F.lag(dollar, 1).over(by_day()) - F.lag(dollar, 2).over(by_day())


def squared_return(close: str, order: str = "day") -> Column:
    step = F.log(close) - F.log(F.lag(close).over(Window.orderBy(order)))
    return step * step


def asof(left: DataFrame, right: DataFrame, on: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    """Backward as-of join: each left row gets the fields of the last right row at or before it,
    its nulls included. One union and one window; with ``by``, within those keys. Right rows must be
    few per key (a calendar) when ``by`` is empty: then the left side is reduced to its distinct
    days first, so that the window holds days, not rows."""
    fields = [c for c in right.columns if c != on and c not in by]
    keys = left.select(*by, on).distinct() if not by else left
    marked = right.select(*by, on, F.struct(*fields).alias("found"), F.lit(0).alias("side"))
    empty = F.lit(None).cast(marked.schema["found"].dataType)
    asked = keys.select(*by, on, *[c for c in keys.columns if c != on and c not in by], empty.alias("found"), F.lit(1).alias("side"))
    w = (Window.partitionBy(*by) if by else Window).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(marked, allowMissingColumns=True).withColumn("found", F.last("found", ignorenulls=True).over(w)).where("side = 1")
    seen = seen.select(*keys.columns, *[F.col("found")[c].alias(c) for c in fields])
    return left.join(seen, on, "left") if not by else seen


def asof_ranges(left: DataFrame, right: DataFrame, on: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Backward as-of join of two large sides: each left row, with the fields of the last right row of
    its key at or before it, nulls included (all null where there is none).

    Both sides are dealt out together by ranges of (key, time), so that a key may fill any number of
    tasks. What the last right row of each range and key is goes on to later ranges in one small table;
    within a range the rest is a running last value. At equal times right rows come first; the right
    side should have one row for each key and time. Null keys match each other, null times come before
    all others. Fields of the same name are an error."""
    fields = [c for c in right.columns if c != on and c not in by]
    if clash := sorted(set(fields) & set(left.columns)):
        raise ValueError(f"both sides have {clash}")
    mine = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(*[F.col(c) for c in fields])
    asked = left.select(*by, on, F.lit(1).alias("_side"), mine.alias("_row"))
    told = right.select(*by, on, F.lit(0).alias("_side"), found.alias("_found"))
    order = [*by, on, "_side"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cut(asked.unionByName(told, allowMissingColumns=True).repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()))
    ends = both.where("_side = 0").groupBy("_range", *by).agg(F.max_by("_found", F.struct(F.col(on).isNotNull(), F.col(on))).alias("_found"))
    here = both.groupBy("_range", *by).agg(F.lit(1).alias("_one")).drop("_one").withColumn("_asks", F.lit(True))
    earlier = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    keyed = lambda df: df.withColumnRenamed("_range", "_at")
    carried = keyed(here).unionByName(keyed(ends).withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    carried = carried.groupBy("_at", *by).agg(F.first("_found", ignorenulls=True).alias("_found"), F.max("_asks").alias("_asks"))
    carried = carried.withColumn("_carry", F.last("_found", ignorenulls=True).over(earlier)).where("_asks").select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_at", "_carry")
    within = Window.partitionBy("_range", *by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_found", F.last("_found", ignorenulls=True).over(within)).where("_side = 1")
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    seen = seen.join(carried, same, "left").withColumn("_found", F.coalesce("_found", "_carry"))
    return seen.select(*[F.col("_row")[c].alias(c) for c in left.columns], *[F.col("_found")[c].alias(c) for c in fields])


def build(daily: DataFrame, horizons: list[int], macro: DataFrame | None = None, event_days: DataFrame | None = None) -> DataFrame:
    """Feature table of all horizons, complete cases only. With ``macro`` the wide set, else the
    short one. Every lag of an instrument comes from one window sort."""
    columns = har_lags() | semivariance_lags() | negative_return_lags() | quarticity_terms()
    rows = daily
    if macro is not None:
        rows = asof(rows, macro)
        if event_days is not None:
            marked = event_days.select("instrument", "day", F.lit(1.0).alias("event")).distinct()
            rows = rows.join(marked, ["instrument", "day"], "left").withColumn("event", F.coalesce("event", F.lit(0.0)))
        else:
            rows = rows.withColumn("event", F.lit(0.0))
        lag = lambda c, k=1: F.lag(c, k).over(by_day())
        columns |= {
            "iv": lag("vix"), "m1w": momentum(), "vix_lag": lag("vix"), "epu_lag": lag("epu"), "hsi_lag": lag("hsi"), "ads_lag": lag("ads"),
            "us3m_change": lag("us3m") - lag("us3m", 2), "event_lag": lag("event"), "dvol": dollar_volume_change(),
        }
    columns |= {f"y{h}": target(h) for h in horizons}
    rows = rows.select("instrument", "day", *[c.alias(n) for n, c in columns.items()])
    names = [c for c in columns if not c.startswith("y")]
    long = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in horizons])).alias("t")
    return rows.select("instrument", "day", *names, long).select("instrument", "day", "t.horizon", *names, "t.y").na.drop()
