"""Cleaning and sampling of intraday bars (instrument, ts, close, volume)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows that are sorted at once.
WINDOWS = 20_000


def day() -> Column:
    """The calendar day of a bar."""
    return F.to_date("ts")


def session_filter(bars: DataFrame, opens: str = "09:30:00", closes: str = "16:00:00") -> DataFrame:
    """Bars whose time of day is in [opens, closes)."""
    at = F.date_format("ts", "HH:mm:ss")
    return bars.where((at >= opens) & (at < closes))


def _bucketed(bars: DataFrame, rows: int, reach: int) -> DataFrame:
    """Deal each instrument's bars, in time order, into buckets of ``rows`` bars, with copies of the
    ``reach`` bars on either side, so that a row window never needs a whole history in one task.
    The rank is a prefix sum of daily counts plus the rank within the day."""
    daily = bars.groupBy("instrument", day().alias("day")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("instrument").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select("instrument", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("instrument", "day").orderBy("ts")
    ranked = (
        bars.withColumn("day", day())
        .withColumn("within", F.row_number().over(within) - 1)
        .join(daily, ["instrument", "day"])
        .withColumn("rank", F.col("before") + F.col("within"))
    )
    low, high = F.greatest(F.col("rank") - reach, F.lit(0)), F.col("rank") + reach
    buckets = F.sequence(F.floor(low / rows), F.floor(high / rows))
    return ranked.withColumn("bucket", F.explode(buckets)).withColumn("own", F.col("bucket") == F.floor(F.col("rank") / rows)).drop("before", "within")


def rolling_median(x: np.ndarray, back: int, ahead: int, least: int) -> np.ndarray:
    """Median of the values (NaN: none) from ``back`` places before to ``ahead`` after each; NaN where
    fewer than ``least`` are there. Windows are sorted ``WINDOWS`` at a time."""
    if not len(x):
        return x
    padded = np.concatenate([np.full(back, np.nan), x, np.full(ahead, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, back + ahead + 1)
    out = np.full(len(x), np.nan)
    for a in range(0, len(x), WINDOWS):
        part = np.sort(windows[a : a + WINDOWS], axis=1)  # missing values come last
        n = (~np.isnan(part)).sum(1)
        at, middle = np.arange(len(part)), np.maximum(n - 1, 0)
        median = (part[at, middle // 2] + part[at, (middle + 1) // 2]) / 2
        out[a : a + len(part)] = np.where(n >= least, median, np.nan)
    return out


def outlier_flags(bars: DataFrame, window: int = 50, least: int = 10, spread: float = 8.0, jump: float | None = 0.1, bucket_rows: int = 200_000) -> DataFrame:
    """Add ``outlier`` (far from the centred rolling median, in robust deviations) and ``jumped``
    (within-day log return too large). The even window reaches one bar further back than ahead. A
    bucket of bars with its copied edges is one Arrow table, in which both are array operations."""
    back, ahead = window // 2, window - window // 2 - 1
    rows = _bucketed(bars, bucket_rows, 2 * window)
    kept = [*bars.columns, *(["day"] if "day" not in bars.columns else [])]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("rank", "ascending")]))
        close = pc.fill_null(table["close"].cast(pa.float64()), np.nan).to_numpy()
        median = rolling_median(close, back, ahead, least)
        away = np.abs(close - median)
        sigma = 1.4826 * rolling_median(away, back, ahead, least)
        jumped = np.zeros(len(close), bool)
        with np.errstate(invalid="ignore", divide="ignore"):
            outlier = (sigma > 0) & (away > spread * sigma)
            if jump is not None and len(close) > 1:
                days = table["day"].cast(pa.int32()).to_numpy()
                fine = (close[1:] > 0) & (close[:-1] > 0) & (days[1:] == days[:-1])
                jumped[1:] = fine & (np.abs(np.log(close[1:]) - np.log(close[:-1])) > jump)
        out = table.select(kept).append_column("outlier", pa.array(outlier)).append_column("jumped", pa.array(jumped))
        return out.filter(table["own"])

    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("outlier", T.BooleanType()), T.StructField("jumped", T.BooleanType())])
    return rows.groupBy("instrument", "bucket").applyInArrow(run, schema)


def clean_bars(bars: DataFrame, jump: float | None = 0.1, spread: float = 8.0, opens: str = "09:30:00", closes: str = "16:00:00") -> DataFrame:
    """Session filter, then without outliers and jumps."""
    return outlier_flags(session_filter(bars, opens, closes), jump=jump, spread=spread).where("not outlier and not jumped").drop("outlier", "jumped")


def sample(bars: DataFrame, minutes: int) -> DataFrame:
    """Last price of each interval (t - minutes, t], labelled t (seconds of the day's epoch), within
    the day. Empty intervals have no row."""
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    step = minutes * 60
    bar = (F.ceil(micros / (step * 1e6)) * step).cast("long").alias("bar")
    return bars.groupBy("instrument", day().alias("day"), bar).agg(F.max_by("close", "ts").alias("price"))


def with_returns(sampled: DataFrame, order: str = "bar") -> DataFrame:
    """Add ``r``, the log return within the day; the first is null."""
    w = Window.partitionBy("instrument", "day").orderBy(order)
    return sampled.withColumn("r", F.log("price") - F.log(F.lag("price").over(w)))


def drop_thin_days(sampled: DataFrame, least: int = 2) -> DataFrame:
    """Days with at least ``least`` sampled prices."""
    n = F.count("*").over(Window.partitionBy("instrument", "day"))
    return sampled.withColumn("n", n).where(F.col("n") >= least).drop("n")
