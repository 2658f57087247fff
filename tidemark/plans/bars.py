"""Queries of groups A to D: scans, cleaning, sampling, realised measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import append
from tidemark.operators import bars as B
from tidemark.operators import measures as D
from tidemark.plans.base import daily, register, returns, rounded
from tidemark.sources import files, views
from tidemark.storage import cut, new_path

#: The ticks' prices jump freely, so the jump limit is wide.
JUMP = 3.0


def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as headerless bar files, one folder a ticker, and scanned again."""
    path = new_path(spark, "bars")
    rows = views.ticks(spark, sf_dir).select(
        "instrument", F.date_format("ts", "MM/dd/yyyy").alias("d"), F.date_format("ts", "HH:mm").alias("t"),
        *[F.col("close").alias(c) for c in ("open", "high", "low", "last")], "volume",
    )
    rows.write.partitionBy("instrument").csv(path)
    raw = spark.read.schema(files.BAR_FIELDS + ", instrument string").csv(path)
    return files.coerce_bars(raw).groupBy("instrument", "ts").agg(F.count("*").alias("n"), F.sum("close").alias("close"), F.sum("volume").alias("volume"))


register("a01_bar_csv_scan", a1, f"SELECT instrument, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n, round(sum(close), 4) AS close, round(sum(volume), 4) AS volume FROM ticks GROUP BY 1, 2", 4)


def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with every seventh row's text spoiled: it becomes null and the bar goes."""
    rows = views.source(spark, sf_dir, "events").where("value > 0")
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return rows.withColumn("t", text).select("event_id", F.expr("try_cast(t as double)").alias("close")).where("close is not null")


register("a02_lenient_numbers", a2, "SELECT event_id, round(value, 6) AS close FROM events WHERE value > 0 AND event_id % 7 <> 0")


def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "layer")
    files.write_layer(daily(spark, sf_dir), path)
    return files.read_layer(spark, path, instrument="R").select("instrument", "day", "rv", "ret", "volume")


register("a03_layer_scan_pruned", a3, f"SELECT instrument, CAST(day AS VARCHAR) AS day, {rounded('rv, ret, volume')} FROM daily WHERE instrument = 'R'")


def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "layer")
    files.write_layer(daily(spark, sf_dir), path)
    return files.read_layer(spark, path).select("instrument", "day", "rv", "rv_pos", "rv_neg", "n_returns")


register("a04_layer_sink", a4, f"SELECT instrument, CAST(day AS VARCHAR) AS day, {rounded('rv, rv_pos, rv_neg')}, n_returns FROM daily")


def a4_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags over a bucketed layer joined with another one: neither needs an exchange."""
    path = new_path(spark, "buckets")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    left = files.write_bucketed(daily(spark, sf_dir).select("instrument", "day", "rv"), name, path, buckets=8)
    right = files.write_bucketed(left.select("instrument", "day", (F.col("rv") * 2).alias("double_rv")), f"{name}_b", f"{path}-b", buckets=8)
    lagged = left.withColumn("before", F.lag("rv").over(Window.partitionBy("instrument").orderBy("day")))
    return lagged.join(right.hint("merge"), ["instrument", "day"])


register("a04_bucketed_layer", a4_bucketed, "SELECT instrument, CAST(day AS VARCHAR) AS day, round(rv, 6) AS rv, round(lag(rv) OVER (PARTITION BY instrument ORDER BY day), 6) AS before, round(rv * 2, 6) AS double_rv FROM daily")


def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "events")
    files.event_map(views.event_days(spark, sf_dir)).write.text(path)
    return files.read_event_days(spark, path)


register("a06_event_json_scan", a6, "SELECT instrument, CAST(day AS VARCHAR) AS day FROM event_days")


def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.source(spark, sf_dir, "orders")
    series = orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))
    named = files.macro_panel(series, list(views.PRIORITIES))
    return named.select("day", *[F.col(f"`{p}`").alias(c) for p, c in views.PRIORITIES.items()])


register("a07_macro_panel", a7, f"SELECT CAST(day AS VARCHAR) AS day, {rounded('vix, epu, ads, us3m, hsi', 4)} FROM macro", 4)

register("b01_session_filter", lambda s, d: B.session_filter(views.ticks(s, d)).select("instrument", "ts", "close"), "SELECT instrument, CAST(ts AS VARCHAR) AS ts, round(close, 6) AS close FROM ticks WHERE strftime(ts, '%H:%M:%S') >= '09:30:00' AND strftime(ts, '%H:%M:%S') < '16:00:00'")

_MEDIAN = "CASE WHEN count({c}) OVER f >= 10 THEN quantile_cont({c}, CAST(0.5 AS DOUBLE)) OVER f END"
_FLAGS = f"""med AS (SELECT *, {_MEDIAN.format(c="close")} AS m FROM ticks WINDOW f AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)),
dev AS (SELECT *, abs(close - m) AS away FROM med),
sig AS (SELECT *, 1.4826 * {_MEDIAN.format(c="away")} AS sigma FROM dev WINDOW f AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)),
flags AS (SELECT *, coalesce(sigma > 0 AND away > 2 * sigma, false) AS outlier,
  coalesce(abs(ln(close) - ln(lag(close) OVER (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts))) > {JUMP}, false) AS jumped FROM sig)"""
register("b02_outlier_filter", lambda s, d: B.outlier_flags(views.ticks(s, d), spread=2.0, jump=JUMP, bucket_rows=1500).where("outlier").select("instrument", "ts", "close"), f", {_FLAGS} SELECT instrument, CAST(ts AS VARCHAR) AS ts, round(close, 6) AS close FROM flags WHERE outlier")
register("b03_jump_filter", lambda s, d: B.outlier_flags(views.ticks(s, d), spread=2.0, jump=JUMP).where("jumped").select("instrument", "ts", "close"), f", {_FLAGS} SELECT instrument, CAST(ts AS VARCHAR) AS ts, round(close, 6) AS close FROM flags WHERE jumped")


def _micro(k: int) -> str:
    return f"CAST(ceil(epoch_us(ts) / ({k} * 60e6)) * {k} * 60 AS BIGINT)"


def _sampled(k: int, source: str = "ticks") -> str:
    return f"""smp AS (SELECT instrument, CAST(ts AS DATE) AS day, {_micro(k)} AS bar, arg_max(close, ts) AS price FROM {source} GROUP BY 1, 2, 3),
rts AS (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY instrument, day ORDER BY bar) AS r FROM smp)"""


register("c01_sampling", lambda s, d: B.sample(views.ticks(s, d), 30), f", {_sampled(30)} SELECT instrument, CAST(day AS VARCHAR) AS day, bar, round(price, 6) AS price FROM smp")
register("c02_intraday_returns", lambda s, d: B.with_returns(B.sample(views.ticks(s, d), 30)), f", {_sampled(30)} SELECT instrument, CAST(day AS VARCHAR) AS day, bar, round(price, 6) AS price, round(r, 6) AS r FROM rts")
register("c03_thin_days", lambda s, d: B.drop_thin_days(B.sample(views.ticks(s, d), 240), 5), f", {_sampled(240)} SELECT instrument, CAST(day AS VARCHAR) AS day, bar, round(price, 6) AS price FROM (SELECT *, count(*) OVER (PARTITION BY instrument, day) AS n FROM smp) WHERE n >= 5")

_RT = "SELECT instrument, CAST(day AS VARCHAR) AS day, {} FROM daily"
for _id, _cols in {"d01_realised_variance": "rv", "d02_semivariances": "rv_pos, rv_neg", "d04_open_to_close": "ret", "d05_volume_and_price": "volume, price"}.items():
    register(_id, lambda s, d, c=_cols: daily(s, d).select("instrument", "day", *[x.strip() for x in c.split(",")]), _RT.format(rounded(_cols, 8)), 8)
register("d03_quarticity", lambda s, d: daily(s, d).select("instrument", "day", "rq", "n_returns"), _RT.format(rounded("rq", 4) + ", n_returns"), 4)


def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks, cleaned, to daily measures."""
    cleaned = B.clean_bars(views.ticks(spark, sf_dir), jump=JUMP, spread=3.0, opens="06:00:00", closes="22:00:00")
    return D.daily_measures(cleaned, 30)


_SESSION = "FROM ticks WHERE strftime(ts, '%H:%M:%S') >= '06:00:00' AND strftime(ts, '%H:%M:%S') < '22:00:00'"
_CLEAN = _FLAGS.replace("FROM ticks WINDOW", f"{_SESSION} WINDOW").replace("away > 2 * sigma", "away > 3 * sigma")
_DAILY = """SELECT i.instrument, i.day, coalesce(sum(r * r), 0.0) AS rv, coalesce(sum(CASE WHEN r > 0 THEN r * r ELSE 0.0 END), 0.0) AS rv_pos,
  coalesce(sum(CASE WHEN r < 0 THEN r * r ELSE 0.0 END), 0.0) AS rv_neg, coalesce(count(r) / 3.0 * sum(r * r * r * r), 0.0) AS rq, CAST(count(r) AS INTEGER) AS n_returns,
  ln(arg_max(price, bar)) - ln(arg_min(price, bar)) AS ret FROM rts AS i GROUP BY 1, 2 HAVING count(*) >= 2"""
_DAYS = f""", {_CLEAN}, cln AS (SELECT * FROM flags WHERE NOT outlier AND NOT jumped), {_sampled(30, "cln")}, dm AS ({_DAILY}),
    vol AS (SELECT instrument, CAST(ts AS DATE) AS day, sum(volume) AS volume, arg_max(close, ts) AS price FROM cln GROUP BY 1, 2)
    SELECT dm.instrument, CAST(dm.day AS VARCHAR) AS day, {rounded("rv, rv_pos, rv_neg, rq", 4)}, n_returns, round(ret, 4) AS ret, round(volume, 4) AS volume, round(price, 4) AS price
    FROM dm LEFT JOIN vol ON dm.instrument = vol.instrument AND dm.day = vol.day"""


def d6_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from three deliveries of ticks: each measures its own days and those left open before."""
    ticks, hours = views.ticks(spark, sf_dir), {"opens": "06:00:00", "closes": "22:00:00"}
    ends = ["2024-01-01", "2024-01-12", "2024-01-13", "2024-02-01"]
    state, out = B.session_filter(ticks.limit(0), **hours).withColumn("open", F.lit(True)), None
    for a, b in zip(ends, ends[1:], strict=False):
        new = ticks.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz")))
        rows, days, state = append.append_bars(state, new, 30, jump=JUMP, spread=3.0, **hours)
        rows, state = cut(rows), cut(state)
        out = rows if out is None else append.replaced(out, rows, cut(days))
    return out


register("d06_daily_measures", d6, _DAYS, 4)
register("d06_appended_days", d6_appended, _DAYS, 4)
register("b12_annualise", lambda s, d: D.annualised(daily(s, d)).select("instrument", "day", (F.col("rv")).alias("rv"), "vol_pct"), "SELECT instrument, CAST(day AS VARCHAR) AS day, round(rv * 252, 4) AS rv, round(sqrt(252 * rv) * 100, 4) AS vol_pct FROM daily", 4)

_PARZEN = "CASE WHEN {x} <= 0.5 THEN 1 - 6 * {x} * {x} + 6 * {x} * {x} * {x} WHEN {x} <= 1 THEN 2 * (1 - {x}) * (1 - {x}) * (1 - {x}) ELSE 0.0 END"
register("d07_parzen", lambda s, d: daily(s, d).select("instrument", "day", D.parzen(F.abs("ret")).alias("k")), f"SELECT instrument, CAST(day AS VARCHAR) AS day, round({_PARZEN.format(x='abs(ret)')}, 6) AS k FROM daily")
register("d08_noise_and_quarticity", lambda s, d: D.noise_and_quarticity(returns(s, d)).where("n > 0"), "SELECT instrument, CAST(day AS VARCHAR) AS day, CAST(count(r) AS INTEGER) AS n, round(sum(r * r) / (2 * count(r)), 5) AS noise, round(count(r) / 3.0 * sum(r * r * r * r), 5) AS iq FROM tr GROUP BY 1, 2 HAVING count(r) > 0", 5)

_BAND = """bw0 AS (SELECT instrument, day, count(r) AS n, sum(r * r) / (2 * count(r)) AS noise, count(r) / 3.0 * sum(r * r * r * r) AS iq FROM {src} GROUP BY 1, 2 HAVING count(*) >= 5),
bw AS (SELECT *, least(greatest(1, CASE WHEN n < 5 THEN n - 1 WHEN iq <= 0 THEN CAST(round_even(sqrt(n), 0) AS BIGINT)
  ELSE CAST(round_even(CAST(3.5134 AS DOUBLE) * pow(noise / sqrt(iq), CAST(0.4 AS DOUBLE)) * pow(n, CAST(0.6 AS DOUBLE)), 0) AS BIGINT) END), n - 1) AS h FROM bw0)"""
register("d09_bandwidth", lambda s, d: D.realised_kernel(returns(s, d), "seq").select("instrument", "day", "bandwidth"), f", {_BAND.format(src='tr')} SELECT instrument, CAST(day AS VARCHAR) AS day, CAST(h AS INTEGER) AS bandwidth FROM bw")


def _kernel(src: str, order: str) -> str:
    return f"""{_BAND.format(src=src)},
pos AS (SELECT instrument, day, r, row_number() OVER (PARTITION BY instrument, day ORDER BY {order}) AS p FROM {src} WHERE r IS NOT NULL),
cov AS (SELECT a.instrument, a.day, b.p - a.p AS k, sum(a.r * b.r) AS g FROM pos a JOIN pos b ON a.instrument = b.instrument AND a.day = b.day AND b.p >= a.p
  JOIN bw ON bw.instrument = a.instrument AND bw.day = a.day AND b.p - a.p <= bw.h GROUP BY 1, 2, 3),
rk AS (SELECT bw.instrument, bw.day, h, greatest(0.0, sum(CASE WHEN k = 0 THEN g ELSE 2 * g * ({_PARZEN.format(x="(CAST(k - 1 AS DOUBLE) / h)")}) END)) AS rk
  FROM bw JOIN cov ON cov.instrument = bw.instrument AND cov.day = bw.day GROUP BY 1, 2, 3)"""


register("d10_realised_kernel", lambda s, d: D.realised_kernel(returns(s, d), "seq"), f", {_kernel('tr', 'seq')} SELECT instrument, CAST(day AS VARCHAR) AS day, round(rk, 5) AS rk, CAST(h AS INTEGER) AS bandwidth FROM rk", 5)


register("d11_measures_by_frequency", lambda s, d: D.by_frequency(views.ticks(s, d), [30, 60]).where("estimator like 'rv%'"), f""", {_sampled(30).replace("smp", "s30").replace("rts", "r30")}, {_sampled(60).replace("smp", "s60").replace("rts", "r60")}
SELECT instrument, CAST(day AS VARCHAR) AS day, estimator, round(coalesce(sum(r * r), 0.0), 5) AS value FROM (SELECT *, 'rv_30m' AS estimator FROM r30 UNION ALL SELECT *, 'rv_60m' FROM r60) GROUP BY instrument, 2, estimator HAVING count(*) >= 2""", 5)
register("d11_kernels_by_frequency", lambda s, d: D.by_frequency(views.ticks(s, d), [30]).where("estimator like 'rk%'"), f", {_sampled(30)}, {_kernel('rts', 'bar')} SELECT instrument, CAST(day AS VARCHAR) AS day, 'rk_30m' AS estimator, round(rk, 5) AS value FROM rk", 5)
