"""The library's tables over a star-schema folder: ticks, trades, macro panel and event days.

Each view has a Spark form and, in ``SQL``, the same definition for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIORITIES = {"1-URGENT": "vix", "2-HIGH": "epu", "3-MEDIUM": "ads", "4-NOT SPECIFIED": "us3m", "5-LOW": "hsi"}
EVENT_PRICE = 490_000.0
TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, ts, close, volume) from the event stream; around-the-clock."""
    return source(spark, sf_dir, "events").where("value > 0").select(
        F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("close"), F.lit(1.0).alias("volume")
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, day, seq, price, volume) from order lines; ``seq`` orders a day. The lines are dealt
    out by instrument and day, so that what follows within a day needs no other exchange."""
    lines = source(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("day"), "l_shipdate", *TRADE_ORDER)
    order = Window.partitionBy("instrument", "day", "l_shipdate").orderBy(*TRADE_ORDER)
    return lines.repartition("instrument", "day").select(
        "instrument",
        "day",
        F.row_number().over(order).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, vix, epu, ads, us3m, hsi): average order value by priority; fields may be null."""
    orders = source(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        *[F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(c) for p, c in PRIORITIES.items()]
    )


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, day): days with an order above a fixed value, for every instrument."""
    days = source(spark, sf_dir, "orders").where(F.col("o_totalprice") > EVENT_PRICE).select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("instrument"), "day")


SQL = f"""
ticks AS (SELECT event_type AS instrument, ts, value AS close, CAST(1.0 AS DOUBLE) AS volume FROM events WHERE value > 0),
trades AS (SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS day,
  row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY {", ".join(TRADE_ORDER)}) AS seq,
  l_extendedprice / l_quantity AS price, l_quantity AS volume FROM lineitem),
macro AS (SELECT CAST(o_orderdate AS DATE) AS day,
  {", ".join(f"avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END) AS {c}" for p, c in PRIORITIES.items())}
  FROM orders GROUP BY 1),
event_days AS (SELECT i.instrument, e.day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > {EVENT_PRICE}) AS e,
  (SELECT unnest(['A', 'N', 'R']) AS instrument) AS i)
"""
