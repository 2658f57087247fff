"""Shared inputs of the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import bars as B
from tidemark.operators import features as E
from tidemark.operators import measures as D
from tidemark.operators import splits
from tidemark.sources import views
from tidemark.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HORIZONS = [1, 5, 22]
RULES = ["RVD", "RVW", "RVM", "AVG3"]


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    """Register a query; doubles are rounded, and days shown as text, in both forms."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(query(spark, sf_dir), digits)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = f"WITH {SQL}{sql}" if sql.startswith(",") else f"WITH {SQL} {sql}"


def shown(df: DataFrame, digits: int) -> DataFrame:
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return F.round(c, digits).alias(f.name)
        if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_returns(views.trades(spark, sf_dir), "seq")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel of the trades, from one pass over them. It is kept, so that plans which read it
    many times don't sort the trades anew each time."""
    volume_and_price = F.sum("volume").alias("volume"), F.max_by("price", "seq").alias("price")
    return cut(D.daily_realised(returns(spark, sf_dir), "seq", also=volume_and_price))


def features(spark: SparkSession, sf_dir: str, horizons: list[int] | None = None, wide: bool = False, panel: DataFrame | None = None) -> DataFrame:
    """The feature table, of the daily ``panel`` where a query has one already."""
    panel = daily(spark, sf_dir) if panel is None else panel
    if wide:
        return E.build(panel, horizons or HORIZONS, views.macro(spark, sf_dir), views.event_days(spark, sf_dir))
    return E.build(panel, horizons or HORIZONS)


def split_features(spark: SparkSession, sf_dir: str, horizons: list[int] | None = None, wide: bool = False, panel: DataFrame | None = None) -> DataFrame:
    return splits.by_fraction(features(spark, sf_dir, horizons, wide, panel), ["instrument", "horizon"])


def forecasts(spark: SparkSession, sf_dir: str, horizons: list[int] | None = None) -> DataFrame:
    """Rule forecasts: the lags themselves and their mean."""
    rows = split_features(spark, sf_dir, horizons or [1])
    rows = rows.withColumns({"RVD": F.col("rvd"), "RVW": F.col("rvw"), "RVM": F.col("rvm"), "AVG3": (F.col("rvd") + F.col("rvw") + F.col("rvm")) / 3})
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in RULES])).alias("f")
    return rows.select("instrument", "horizon", "day", "split", "y", long).select("instrument", "horizon", "day", "split", "y", "f.model", "f.y_pred")


def test_forecasts(spark: SparkSession, sf_dir: str, horizons: list[int] | None = None) -> DataFrame:
    return forecasts(spark, sf_dir, horizons).where("split = 'test'")


def _full(fn: str, c: str, first: int, last: int) -> str:
    bound = lambda k: f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}" if k else "CURRENT ROW"
    over = f"OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN {bound(first)} AND {bound(last)})"
    return f"CASE WHEN count({c}) {over} = {last - first + 1} THEN {fn}({c}) {over} END"


_W = "OVER (PARTITION BY instrument ORDER BY day)"
LOW = "(CASE WHEN ret < 0 THEN ret ELSE 0.0 END)"
SHORT = f"""lag(rv) {_W} AS rvd, {_full("avg", "rv", -5, -1)} AS rvw, {_full("avg", "rv", -22, -1)} AS rvm,
  lag(rv_pos) {_W} AS rvd_pos, lag(rv_neg) {_W} AS rvd_neg,
  lag({LOW}) {_W} AS rn_d, {_full("avg", LOW, -5, -1)} AS rn_w, {_full("avg", LOW, -22, -1)} AS rn_m,
  sqrt(greatest(lag(rq) {_W}, 0.0)) * lag(rv) {_W} AS rq_x_rv, lag(rq) {_W} AS rq_lag"""
SHORT_NAMES = ["rvd", "rvw", "rvm", "rvd_pos", "rvd_neg", "rn_d", "rn_w", "rn_m", "rq_x_rv", "rq_lag"]
_TARGETS = ", ".join(f"{_full('avg', 'rv', 0, h - 1)} AS y{h}" for h in HORIZONS)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in SHORT_NAMES)

SQL = f"""{views.SQL.strip()},
tr AS (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY instrument, day ORDER BY seq) AS r FROM trades),
daily AS (SELECT instrument, day, coalesce(sum(r * r), 0.0) AS rv, coalesce(sum(CASE WHEN r > 0 THEN r * r ELSE 0.0 END), 0.0) AS rv_pos,
  coalesce(sum(CASE WHEN r < 0 THEN r * r ELSE 0.0 END), 0.0) AS rv_neg, coalesce(count(r) / 3.0 * sum(r * r * r * r), 0.0) AS rq,
  CAST(count(r) AS INTEGER) AS n_returns, ln(arg_max(price, seq)) - ln(arg_min(price, seq)) AS ret, sum(volume) AS volume, arg_max(price, seq) AS price
  FROM tr GROUP BY 1, 2 HAVING count(*) >= 2),
feat0 AS (SELECT instrument, day, {SHORT}, {_TARGETS} FROM daily),
feats AS (SELECT instrument, day, horizon, {", ".join(SHORT_NAMES)}, y FROM (
  {" UNION ALL ".join(f"SELECT *, {h} AS horizon, y{h} AS y FROM feat0" for h in HORIZONS)}) WHERE y IS NOT NULL AND {_COMPLETE}),
placed AS (SELECT *, row_number() OVER (PARTITION BY instrument, horizon ORDER BY day) AS rn, count(*) OVER (PARTITION BY instrument, horizon) AS n FROM feats),
splitted AS (SELECT *, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.7 AS DOUBLE)) + floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM placed),
fc_all AS (SELECT instrument, horizon, day, split, y, m.model AS model, CASE m.model WHEN 'RVD' THEN rvd WHEN 'RVW' THEN rvw WHEN 'RVM' THEN rvm ELSE (rvd + rvw + rvm) / 3 END AS y_pred
  FROM splitted, (SELECT unnest(['RVD', 'RVW', 'RVM', 'AVG3']) AS model) AS m),
fc AS (SELECT * FROM fc_all WHERE horizon = 1),
test AS (SELECT * FROM fc WHERE split = 'test'),
floors AS (SELECT instrument, model, greatest(1e-12, 1e-3 * coalesce(min(CASE WHEN y > 0 THEN y END), 0.0)) AS fl FROM test GROUP BY 1, 2),
losses AS (SELECT t.*, (y - y_pred) * (y - y_pred) AS mse, abs(y - y_pred) AS mae,
  greatest(y, fl) / greatest(y_pred, fl) - ln(greatest(y, fl) / greatest(y_pred, fl)) - 1 AS qlike FROM test t JOIN floors USING (instrument, model)),
losstab AS (SELECT instrument, model, l.loss AS loss, avg(CASE l.loss WHEN 'mse' THEN mse WHEN 'mae' THEN mae ELSE qlike END) AS value
  FROM losses, (SELECT unnest(['mse', 'mae', 'qlike']) AS loss) AS l GROUP BY 1, 2, 3),
ratiotab AS (SELECT *, value / max(CASE WHEN model = 'RVM' THEN value END) OVER (PARTITION BY instrument, loss) AS ratio FROM losstab)"""


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))
