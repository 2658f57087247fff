"""Files in and out: bar CSV, event-date JSON, layered parquet, result tables, forecast stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_FIELDS = "d string, t string, open string, high string, low string, close string, volume string"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Headerless minute-bar CSV (date, time, open, high, low, close, volume); the instrument is the
    file's name up to its first dot. Text that is no number becomes null; bars without a close go."""
    raw = spark.read.schema(BAR_FIELDS).csv(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/.]+)\.[^/]*$", 1)
    return coerce_bars(raw.withColumn("instrument", name))


def coerce_bars(raw: DataFrame) -> DataFrame:
    """Typed bars from the text fields of ``BAR_FIELDS`` and ``instrument``."""
    stamp = F.expr("cast(try_to_timestamp(concat_ws(' ', d, t), 'MM/dd/yyyy HH:mm') as timestamp_ntz)")
    numbers = [F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return raw.select("instrument", stamp.alias("ts"), *numbers).where("close is not null and ts is not null")


def read_event_days(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, day) from a JSON map of instrument to dates."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("instrument", "days"))
    return parsed.select("instrument", F.explode("days").alias("day")).select("instrument", F.col("day").cast("date").alias("day")).distinct()


def event_map(days: DataFrame) -> DataFrame:
    """The inverse: one JSON document of instrument to sorted dates."""
    lists = days.groupBy("instrument").agg(F.sort_array(F.collect_set(F.col("day").cast("string"))).alias("days"))
    return lists.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("instrument", "days"))))).alias("value"))


def write_layer(df: DataFrame, path: str, by: tuple[str, ...] = ("instrument",), order: tuple[str, ...] = ("day",)) -> None:
    """A parquet layer, partitioned by directory so that readers prune. Rows are dealt out by ranges of
    the keys and the order within them, so that a key with many rows is written by several tasks, each
    a sorted file of its own, and small keys share one. ``order`` columns that aren't there are left out."""
    within = [c for c in order if c in df.columns and c not in by]
    df.repartitionByRange(*by, *within).sortWithinPartitions(*by, *within).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, by: tuple[str, ...] = ("instrument",), order: tuple[str, ...] = ("day",), buckets: int = 200) -> DataFrame:
    """A parquet table in buckets of the keys, each one sorted file, and the table read back: windows
    over the keys and joins with tables of the same buckets need no exchange (joins on more columns than
    the keys: under ``session.SETTINGS``). A bucket is written by one
    task, so keys should be many, with a bounded number of rows each (a calendar)."""
    spark = df.sparkSession
    dealt = df.repartition(buckets, *by).sortWithinPartitions(*by, *order)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by, *order).saveAsTable(name)
    return spark.table(name)


def read_layer(spark: SparkSession, path: str, schema: str | None = None, **only) -> DataFrame:
    """Read a layer; keyword filters on partition columns prune directories."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), only.items(), reader.parquet(path))


def macro_panel(series: DataFrame, names: list[str]) -> DataFrame:
    """Outer-align dated series (series, day, value) into one row per day."""
    return series.groupBy("day").pivot("series", names).agg(F.first("value", ignorenulls=True))


def merge_runs(stores: list[DataFrame], keys: list[str], validation: bool = False, **only) -> DataFrame:
    """Forecast runs of several stores; the same key and day in a later store wins. Keyword filters
    (horizon, feature_set, ...) take one value of a column. Validation forecasts (``split``) come
    along only if asked for, as combinations need them and tests don't."""
    ranked = reduce(DataFrame.unionByName, [df.withColumn("store", F.lit(i)) for i, df in enumerate(stores)])
    if "split" in ranked.columns and not validation:
        ranked = ranked.where("split = 'test'")
    ranked = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), only.items(), ranked)
    last = Window.partitionBy(*keys).orderBy(F.col("store").desc())
    return ranked.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn", "store")


def result_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables in one long table (table_name, instrument, model, value)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "instrument", "model", "value") for name, df in tables.items()])


def markdown(tables: dict[str, DataFrame], digits: int = 3) -> DataFrame:
    """(table_name, line, text): result tables as Markdown, each with a heading, a column line and a
    line per row in the order of its text; numbers have ``digits`` places. Tables are reports of a few
    thousand rows; lines are numbered within a table."""
    out = []
    for name, df in tables.items():
        shown = [F.coalesce(F.format_string(f"%.{digits}f", F.round(c, digits)) if kind == "double" else F.col(c).cast("string"), F.lit("")) for c, kind in df.dtypes]
        body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("text"))
        lines = body.select((F.row_number().over(Window.orderBy("text")) + 3).alias("line"), "text")
        head = df.sparkSession.createDataFrame([(1, f"## {name}"), (2, f"| {' | '.join(df.columns)} |"), (3, "|" + "---|" * len(df.columns))], "line int, text string")
        out.append(head.unionByName(lines).select(F.lit(name).alias("table_name"), "line", "text"))
    return reduce(DataFrame.unionByName, out)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
