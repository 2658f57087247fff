"""Streaming form of interval sampling, for bars that arrive late and out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_stream(bars: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Last price of each interval (t - minutes, t] of a stream of (instrument, ts, close), emitted
    once the watermark has passed t. Windows are closed on the left, so the clock is set back by a
    microsecond. ``ts`` is a timestamp. Bars later than ``late`` are too late for their interval."""
    moved = bars.withColumn("at", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("at", late)
    price = F.max_by("close", "ts").alias("price")
    sampled = moved.groupBy("instrument", F.window("at", f"{minutes} minutes").alias("w")).agg(price)
    return sampled.select("instrument", F.unix_timestamp(F.col("w.end")).alias("bar"), "price")
