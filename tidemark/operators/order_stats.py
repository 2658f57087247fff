"""Places and order statistics of long series, in blocks, so that no task holds a series.

``place`` numbers the rows of each key in an order: rows are dealt out by range, each range counts its
keys, and a row's number is its number within the range plus what earlier ranges hold.

``running_quantiles`` answers, for many rows of a series, the quantile of all values before the row.
Rows get a place in time and a rank by value, both cut into blocks. Counts of (time block, rank block)
cells, summed over earlier time blocks, tell for a row in which rank block its order statistic lies,
once the row's own time block is added up to it; that rank block's values before the row then give it.
A group of work is one block of time, or one rank block as one block of time asks it.

``quantiles`` selects exact quantiles of groups of any size: a sketch bounds each, one aggregation counts
what lies below the bounds, and only the values between them are ranked.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import cut

#: Least rows of a block; a block of a series of n rows has 4 * sqrt(n) of them, so that there are fewer cells than rows.
BLOCK = 2048
#: Parts that a rank block's values are joined in, as most rows may ask the same one.
SALT = 16
#: Of the sketch that bounds a quantile.
ACCURACY = 10_000
#: Bounds of up to so many groups are broadcast.
FEW_GROUPS = 100_000


def place(rows: DataFrame, keys: list[str], order: list[str], name: str, counted: dict[str, Column] | None = None) -> DataFrame:
    """Add ``name``, the place from 1 in the order within the keys, and ``name_n``, how many there are;
    for each of ``counted``, the rows before this one where it is true and, as ``_n``, all of them.
    ``order`` should have no ties: tied rows are numbered in an order of their own."""
    spark = rows.sparkSession
    counted = {name: F.lit(True)} | (counted or {})
    flagged = rows.withColumns({f"_on_{c}": F.coalesce(on, F.lit(False)).cast("long") for c, on in counted.items()})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(flagged.repartitionByRange(tasks, *keys, *order).withColumn("_range", F.spark_partition_id()))
    held = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_on_{c}").alias(f"_held_{c}") for c in counted])
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*keys, "_range", *[F.coalesce(F.sum(f"_held_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in counted], *[F.sum(f"_held_{c}").over(whole).alias(f"{c}_n") for c in counted])
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    own = {c: F.col(f"_before_{c}") + F.coalesce(F.sum(f"_on_{c}").over(earlier), F.lit(0)) + (1 if c == name else 0) for c in counted}
    numbered = ranged.join(held, [*keys, "_range"]).withColumns(own)
    return numbered.drop("_range", *[f"_on_{c}" for c in counted], *[f"_before_{c}" for c in counted])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q, n): exact quantiles (linear between neighbours) of the values of each group, in the order
    of ``shares``, and their number. Null and NaN values count as missing; a group without values has no row.

    The sketch is off by at most n / ACCURACY ranks, so its bounds are taken that much and more apart;
    the counts prove that they hold the ranks that are asked, else the job fails. Groups of up to
    4 * ACCURACY rows are ranked as a whole."""
    if not keys:
        return quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], value, shares).drop("_all")
    x, places = F.col(value).cast("double"), range(len(shares))
    rows = cut(rows.where(F.col(value).isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_v")))
    margin = 4 / ACCURACY
    low, high = ([min(max(q + m, 0.0), 1.0) for q in shares] for m in (-margin, margin))
    array = lambda v: F.array(*map(F.lit, v))
    bounds = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", array(low), ACCURACY).alias("_low"), F.percentile_approx("_v", array(high), ACCURACY).alias("_high"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    small = F.col("_n") <= 4 * ACCURACY
    whole = lambda c: F.array(*[F.col(c)] * len(shares))
    bounds = cut(bounds.select(*keys, "_n", F.when(small, whole("_min")).otherwise(F.col("_low")).alias("_low"), F.when(small, whole("_max")).otherwise(F.col("_high")).alias("_high")))
    side = F.broadcast(bounds) if bounds.count() <= FEW_GROUPS else bounds
    beside = rows.join(side, keys)
    below = beside.groupBy(*keys).agg(F.max("_n").alias("n"), F.array(*[F.sum((F.col("_v") < F.col("_low")[i]).cast("long")) for i in places]).alias("_below"))
    inside = F.array(*[F.when((F.col("_v") >= F.col("_low")[i]) & (F.col("_v") <= F.col("_high")[i]), F.lit(i)) for i in places])
    ranked = place(beside.select(*keys, "_v", F.explode(F.array_compact(inside)).alias("_at")), [*keys, "_at"], ["_v"], "_r")
    asked = below.select(*keys, "n", F.posexplode(F.arrays_zip(F.col("_below").alias("below"), array(shares).alias("share"))).alias("_at", "_a"))
    first = F.floor(F.col("_a.share") * (F.col("n") - 1))
    asked = asked.select(*keys, "n", "_at", F.col("_a.below").alias("_below"), first.alias("_k"), (F.col("_a.share") * (F.col("n") - 1) - first).alias("_weight"))
    found = asked.join(ranked, [*keys, "_at"])
    rank = F.col("_below") + F.col("_r") - 1
    here = lambda k: F.max(F.when(rank == k, F.col("_v")))
    top = F.least(F.col("_k") + 1, F.col("n") - 1)
    one = found.groupBy(*keys, "n", "_at").agg(here(F.col("_k")).alias("_a"), here(top).alias("_b"), F.first("_weight").alias("_weight"))
    lost = F.raise_error(F.lit("the sketch's bounds don't hold the rank that is asked")).cast("double")
    one = one.withColumn("_q", F.when(F.col("_a").isNull() | F.col("_b").isNull(), lost).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_weight")))
    return one.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_q"))), lambda p: p["_q"]).alias("q")).select(*keys, "q", "n")


def blocked(rows: DataFrame, keys: list[str], value: str, asked: Column) -> DataFrame:
    """(keys, t, t_n, v, asked, r, r_n, size, tb, rb): the rows with the rank of their value and the
    blocks of their place and rank (null without a value)."""
    known = F.col(value).isNotNull() & ~F.isnan(value)
    slim = rows.select(*keys, "t", "t_n", F.when(known, F.col(value)).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    nothing = F.lit(None).cast("long")
    ranked = place(slim.where("v is not null"), keys, ["v", "t"], "r").unionByName(slim.where("v is null").withColumns({"r": nothing, "r_n": nothing}))
    size = F.greatest(F.lit(BLOCK), F.ceil(4 * F.sqrt("t_n")))
    block = lambda c: F.floor((F.col(c) - 1) / F.col("size")).cast("int")
    return cut(ranked.withColumn("size", size).withColumns({"tb": block("t"), "rb": block("r")}))


def _paired(left: DataFrame, right: DataFrame, by: list[str]):
    """Groups of both sides, which may have come from one table."""
    return left.groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by))


def running_quantiles(rows: DataFrame, keys: list[str], value: str, asked: Column, share: float) -> DataFrame:
    """(keys, t, q) for the asked rows: the quantile (linear between neighbours) of the values at places
    before ``t``; rows need ``t`` and ``t_n`` of ``place``. Null and NaN values count as missing; a row
    with nothing before it has no answer."""
    kinds, points = [rows.schema[k] for k in keys], blocked(rows, keys, value, asked)
    cells = points.where("rb is not null").groupBy(*keys, "tb", "rb").agg(F.count("*").alias("c"))
    blocks = F.sequence(F.lit(0), F.col("last"))
    grid = points.groupBy(*keys).agg(F.max("tb").alias("last")).withColumn("tb", F.explode(blocks)).withColumn("rb", F.explode(blocks)).drop("last")
    earlier = Window.partitionBy(*keys, "rb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    sums = grid.join(cells, [*keys, "tb", "rb"], "left").withColumn("c", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    prefix = sums.groupBy(*keys, "tb").agg(F.transform(F.sort_array(F.collect_list(F.struct("rb", "c"))), lambda x: x["c"]).alias("counts"))

    def locate(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        counts = np.array(before["counts"].iloc[0], np.int64)
        own = own.sort_values("t")
        out = []
        for t, asks, rb in zip(own["t"].tolist(), own["asked"].tolist(), own["rb"].tolist(), strict=True):
            if asks and (n := int(counts.sum())):
                at = share * (n - 1)
                ends = counts.cumsum()
                for part, k in enumerate((int(at), min(int(at) + 1, n - 1))):
                    b = int(np.searchsorted(ends, k, side="right"))
                    out.append((t, part, at - int(at), b, k - int(ends[b] - counts[b])))
            if rb == rb and rb is not None:
                counts[int(rb)] += 1
        found = own[[*keys, "tb"]].iloc[[0] * len(out)].reset_index(drop=True)
        kinds = {"t": np.int64, "part": np.int32, "weight": float, "rb": np.int32, "nth": np.int64}
        return found.assign(**{c: np.array([o[i] for o in out], kind) for i, (c, kind) in enumerate(kinds.items())})

    asks_kind = T.StructType([*kinds, T.StructField("tb", T.IntegerType()), T.StructField("t", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("rb", T.IntegerType()), T.StructField("nth", T.LongType())])
    asks = cut(_paired(points.select(*keys, "tb", "t", "rb", "asked"), prefix, [*keys, "tb"]).applyInPandas(locate, asks_kind))

    def answer(own: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        values, own = values.sort_values("t"), own.sort_values("t")
        times, ranks = values["t"].to_numpy(), values["r"].tolist()
        value_of = dict(zip(ranks, values["v"].tolist(), strict=True))
        seen, held, out = 0, [], []
        for t, nth in zip(own["t"].tolist(), own["nth"].tolist(), strict=True):
            upto = int(np.searchsorted(times, t, side="left"))
            for r in ranks[seen:upto]:
                insort(held, r)
            seen = upto
            out.append(value_of[held[nth]])
        return own[[*keys, "t", "part", "weight"]].assign(v=out)

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    wanted = asks.select(*keys, "rb", "tb").distinct().select("*", salt)
    values = points.where("rb is not null").select(*keys, "rb", "t", "r", "v", F.pmod("r", F.lit(SALT)).cast("int").alias("salt")).join(wanted, [*keys, "rb", "salt"])
    told = T.StructType([*kinds, T.StructField("t", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("v", T.DoubleType())])
    by = [*keys, "rb", "tb"]
    found = _paired(asks, values.select(*by, "t", "r", "v"), by).applyInPandas(answer, told)
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("v")))
    return found.groupBy(*keys, "t").agg((of(0) + (of(1) - of(0)) * F.first("weight")).alias("q"))
