"""Queries of groups B (splits), E (features) and F (joins and set operations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import features as E
from tidemark.operators import losses as L
from tidemark.operators import append, combine, inference, splits
from tidemark.plans.base import daily, features, forecasts, register, rounded, split_features, test_forecasts
from tidemark.sources import files, runs, views
from tidemark.storage import cut, new_path

DAY = "CAST(day AS VARCHAR) AS day"
KEYS = ["instrument", "horizon"]


def _lags(columns: dict) -> callable:
    return lambda s, d: daily(s, d).select("instrument", "day", *[c.alias(n) for n, c in columns().items()])


for _id, _make, _names, _digits in (
    ("e01_har_lags", E.har_lags, "rvd, rvw, rvm", 6),
    ("e02_semivariance_lags", E.semivariance_lags, "rvd_pos, rvd_neg", 6),
    ("e03_negative_return_lags", E.negative_return_lags, "rn_d, rn_w, rn_m", 6),
    ("e04_quarticity_terms", E.quarticity_terms, "rq_x_rv, rq_lag", 3),
    ("e05_horizon_targets", lambda: {f"y{h}": E.target(h) for h in (1, 5, 22)}, "y1, y5, y22", 6),
):
    register(_id, _lags(_make), f"SELECT instrument, {DAY}, {rounded(_names, _digits)} FROM feat0", _digits)

_O = "OVER (PARTITION BY instrument ORDER BY day)"
register("e06_momentum", _lags(lambda: {"m1w": E.momentum()}), f"SELECT instrument, {DAY}, round(CASE WHEN count(ret) OVER w = 5 THEN sum(ret) OVER w END, 6) AS m1w FROM daily WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
register("e07_dollar_volume_change", _lags(lambda: {"dvol": E.dollar_volume_change()}), f"SELECT instrument, {DAY}, round(lag(ln(nullif(price * volume, 0)), 1) {_O} - lag(ln(nullif(price * volume, 0)), 2) {_O}, 6) AS dvol FROM daily")
register("e08_squared_index_return", lambda s, d: views.macro(s, d).where("vix is not null").select("day", E.squared_return("vix").alias("r2")), f"SELECT {DAY}, round(pow(ln(vix) - lag(ln(vix)) OVER (ORDER BY day), 2), 6) AS r2 FROM macro WHERE vix IS NOT NULL")

_ASOF = """days AS (SELECT DISTINCT day FROM daily), filled AS (SELECT d.instrument, d.day, d.ret, d.rv, m.vix, m.epu, m.ads, m.us3m, m.hsi FROM daily d ASOF LEFT JOIN macro m ON d.day >= m.day)"""


def _with_macro(s: SparkSession, d: str) -> DataFrame:
    return E.asof(daily(s, d), views.macro(s, d))


register("f03_asof_join", lambda s, d: _with_macro(s, d).select("instrument", "day", "vix", "epu", "ads", "us3m", "hsi"), f", {_ASOF} SELECT instrument, {DAY}, {rounded('vix, epu, ads, us3m, hsi', 4)} FROM filled", 4)
register("e09_rate_change", lambda s, d: _with_macro(s, d).select("instrument", "day", (F.lag("us3m").over(E.by_day()) - F.lag("us3m", 2).over(E.by_day())).alias("us3m_change")), f", {_ASOF} SELECT instrument, {DAY}, round(lag(us3m, 1) {_O} - lag(us3m, 2) {_O}, 4) AS us3m_change FROM filled", 4)
register("e11_implied_vol_proxy", lambda s, d: _with_macro(s, d).select("instrument", "day", F.lag("vix").over(E.by_day()).alias("iv")), f", {_ASOF} SELECT instrument, {DAY}, round(lag(vix) {_O}, 4) AS iv FROM filled", 4)




def quotes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ticks of all instruments but one, and that one's as the price to refer to."""
    events = views.source(s, d, "events").where("value > 0").select("user_id", F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("close"))
    return events.where("instrument <> 'purchase'"), events.where("instrument = 'purchase'").select("user_id", "ts", F.col("close").alias("reference"), F.col("ts").alias("quoted"))


_QUOTES = "ql AS (SELECT user_id, event_type AS instrument, ts, value AS close FROM events WHERE value > 0 AND event_type <> 'purchase'), qr AS (SELECT user_id, ts, value AS reference FROM events WHERE value > 0 AND event_type = 'purchase')"
_QUOTED = "SELECT l.instrument, CAST(l.ts AS VARCHAR) AS ts, round(l.close, 6) AS close, round(r.reference, 6) AS reference, CAST(r.ts AS VARCHAR) AS quoted"
register("f03_asof_one_reference", lambda s, d: E.asof_ranges(quotes(s, d)[0], quotes(s, d)[1].drop("user_id"), "ts").drop("user_id"), f", {_QUOTES} {_QUOTED} FROM ql l ASOF LEFT JOIN qr r ON l.ts >= r.ts")
register("f03_asof_by_user", lambda s, d: E.asof_ranges(*quotes(s, d), "ts", ("user_id",)), f", {_QUOTES} {_QUOTED.replace('SELECT l.', 'SELECT l.user_id, l.', 1)} FROM ql l ASOF LEFT JOIN qr r ON l.user_id = r.user_id AND l.ts >= r.ts")


def e10(s: SparkSession, d: str) -> DataFrame:
    marked = views.event_days(s, d).withColumn("event", F.lit(1))
    return daily(s, d).join(marked, ["instrument", "day"], "left").select("instrument", "day", F.lag(F.coalesce("event", F.lit(0))).over(E.by_day()).alias("event_lag"))


register("e10_event_dummy", e10, f"SELECT d.instrument, CAST(d.day AS VARCHAR) AS day, lag(CASE WHEN e.day IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY d.instrument ORDER BY d.day) AS event_lag FROM daily d LEFT JOIN event_days e ON d.instrument = e.instrument AND d.day = e.day")
register("e12_feature_table", lambda s, d: features(s, d).select("instrument", "day", "horizon", "rvd", "rvw", "rvm", "rn_m", "y"), f"SELECT instrument, {DAY}, horizon, {rounded('rvd, rvw, rvm, rn_m, y')} FROM feats")

WIDE = f""", {_ASOF},
w0 AS (SELECT d.*, a.vix, a.epu, a.ads, a.us3m, a.hsi, CASE WHEN e.day IS NULL THEN 0.0 ELSE 1.0 END AS event FROM daily d JOIN filled a ON a.instrument = d.instrument AND a.day = d.day LEFT JOIN event_days e ON e.instrument = d.instrument AND e.day = d.day),
w1 AS (SELECT instrument, day, lag(vix) {_O} AS iv, CASE WHEN count(ret) OVER w5 = 5 THEN sum(ret) OVER w5 END AS m1w, lag(epu) {_O} AS epu_lag, lag(hsi) {_O} AS hsi_lag, lag(ads) {_O} AS ads_lag,
  lag(us3m) {_O} - lag(us3m, 2) {_O} AS us3m_change, lag(event) {_O} AS event_lag, lag(ln(nullif(price * volume, 0)), 1) {_O} - lag(ln(nullif(price * volume, 0)), 2) {_O} AS dvol FROM w0
  WINDOW w5 AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
wide AS (SELECT w1.instrument, w1.day, f.rvd, f.rvw, f.rvm, iv, m1w, iv AS vix_lag, epu_lag, hsi_lag, ads_lag, us3m_change, event_lag, dvol, y FROM w1 JOIN feats f ON f.instrument = w1.instrument AND f.day = w1.day AND f.horizon = 1
  WHERE iv IS NOT NULL AND m1w IS NOT NULL AND epu_lag IS NOT NULL AND hsi_lag IS NOT NULL AND ads_lag IS NOT NULL AND us3m_change IS NOT NULL AND event_lag IS NOT NULL AND dvol IS NOT NULL)"""
_WIDE_NAMES = "iv, m1w, epu_lag, hsi_lag, ads_lag, us3m_change, event_lag, dvol, y"
register("e12_wide_feature_table", lambda s, d: features(s, d, [1], wide=True).select("instrument", "day", *_WIDE_NAMES.split(", ")), f"{WIDE} SELECT instrument, {DAY}, {rounded(_WIDE_NAMES, 4)} FROM wide", 4)

def e12_appended(s: SparkSession, d: str, wide: bool = False) -> DataFrame:
    """The feature table from three deliveries of days, each with what the one before left open."""
    panel, horizons = cut(daily(s, d)), [1, 5, 22]
    calendars = (views.macro(s, d), views.event_days(s, d)) if wide else (None, None)
    ends = ["1990-01-01", "1997-06-30", "1999-12-31", "2100-01-01"]
    out, state = None, panel.limit(0)
    for a, b in zip(ends, ends[1:], strict=False):
        rows, state = append.append_days(state, panel.where((F.col("day") > a) & (F.col("day") <= b)), horizons, *calendars)
        state = cut(state)
        out = rows if out is None else out.unionByName(rows)
    return out


register("e12_appended_days", lambda s, d: e12_appended(s, d).select("instrument", "day", "horizon", "rvd", "rvw", "rvm", "rn_m", "y"), f"SELECT instrument, {DAY}, horizon, {rounded('rvd, rvw, rvm, rn_m, y')} FROM feats")
register("e12_appended_wide_days", lambda s, d: e12_appended(s, d, True).where("horizon = 1").select("instrument", "day", *_WIDE_NAMES.split(", ")), f"{WIDE} SELECT instrument, {DAY}, {rounded(_WIDE_NAMES, 4)} FROM wide", 4)


# --- splits --------------------------------------------------------------------------------------

register("b04_model_columns", lambda s, d: splits.model_columns(features(s, d, [5]), "M_HAR").drop("horizon", "y"), f"SELECT instrument, {DAY}, {rounded('rvd, rvw, rvm')} FROM feats WHERE horizon = 5")
_M_ALL = "rvd, rvw, rvm, iv, m1w, vix_lag, epu_lag, hsi_lag, ads_lag, us3m_change, event_lag, dvol, y"
register("b04_wide_model_columns", lambda s, d: splits.model_columns(features(s, d, [1], wide=True), "M_ALL").drop("horizon"), f"{WIDE} SELECT instrument, {DAY}, {rounded(_M_ALL, 4)} FROM wide", 4)
register("b05_complete_cases", lambda s, d: features(s, d).groupBy("instrument", "horizon").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last")), "SELECT instrument, horizon, count(*) AS n, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM feats GROUP BY 1, 2")
register("b06_fraction_split", lambda s, d: split_features(s, d).select("instrument", "horizon", "day", "split", "rn"), f"SELECT instrument, horizon, {DAY}, split, rn FROM splitted")
register("b07_date_split", lambda s, d: splits.by_date(features(s, d), KEYS, "1997-12-31", "1998-06-30").groupBy(*KEYS, "split").agg(F.count("*").alias("n")), "SELECT instrument, horizon, CASE WHEN day <= DATE '1997-12-31' THEN 'train' WHEN day <= DATE '1998-06-30' THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM feats GROUP BY 1, 2, 3")
register("b08_size_split", lambda s, d: splits.by_size(features(s, d), KEYS, 1000).groupBy(*KEYS, "split").agg(F.count("*").alias("n"), F.min("day").alias("first")), "SELECT instrument, horizon, CASE WHEN rn <= 1000 THEN 'train' WHEN rn <= 1200 THEN 'val' ELSE 'test' END AS split, count(*) AS n, CAST(min(day) AS VARCHAR) AS first FROM placed WHERE n > 1200 GROUP BY 1, 2, 3")
_COUNT = "CAST(sum(CASE WHEN split = '{0}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{0}"
register("b09_history_guard", lambda s, d: splits.guarded(split_features(s, d), KEYS, 1800), f"SELECT *, n_train < 1800 OR n_val < 20 OR n_test < 50 AS rejected FROM (SELECT instrument, horizon, {', '.join(_COUNT.format(x) for x in ('train', 'val', 'test'))} FROM splitted GROUP BY 1, 2)")


def b10(s: SparkSession, d: str) -> DataFrame:
    rows = split_features(s, d, [1])
    shifted = forecasts(s, d).where("split = 'test'").withColumn("y_pred", F.col("y_pred") - 10)
    return splits.floored(shifted, rows.where("split = 'train'"), KEYS).select("instrument", "day", "model", "y_pred")


register("b10_positivity_floor", b10, f"""SELECT t.instrument, CAST(t.day AS VARCHAR) AS day, t.model, round(greatest(t.y_pred - 10, CASE WHEN m.least > 0 THEN m.least ELSE 1e-12 END), 6) AS y_pred
FROM test t JOIN (SELECT instrument, min(y) AS least FROM splitted WHERE split = 'train' AND horizon = 1 GROUP BY 1) m ON m.instrument = t.instrument""")
register("b11_date_slice", lambda s, d: test_forecasts(s, d).where("day between '2000-02-01' and '2000-06-30'").select("instrument", "day", "model", "y_pred"), f"SELECT instrument, {DAY}, model, round(y_pred, 6) AS y_pred FROM test WHERE day BETWEEN DATE '2000-02-01' AND DATE '2000-06-30'")
register("b13_comparison_view", lambda s, d: test_forecasts(s, d).where("day between '2000-02-01' and '2000-12-31'").select("instrument", "day", "model", (F.sqrt(F.col("y") * 252) * 100).alias("actual_pct"), (F.sqrt(F.col("y_pred") * 252) * 100).alias("forecast_pct")), f"SELECT instrument, {DAY}, model, round(sqrt(y * 252) * 100, 4) AS actual_pct, round(sqrt(y_pred * 252) * 100, 4) AS forecast_pct FROM test WHERE day BETWEEN DATE '2000-02-01' AND DATE '2000-12-31'", 4)

# --- joins and set operations --------------------------------------------------------------------


def f1(s: SparkSession, d: str) -> DataFrame:
    truth = features(s, d, [1]).select("instrument", "day", "y")
    return truth.join(test_forecasts(s, d).where("model = 'RVW'").select("instrument", "day", "y_pred"), ["instrument", "day"])


register("f01_inner_join", f1, f"SELECT instrument, {DAY}, round(y, 6) AS y, round(y_pred, 6) AS y_pred FROM test WHERE model = 'RVW'")
register("f02_left_join", lambda s, d: daily(s, d).select("instrument", "day", "rv", "volume"), f"SELECT instrument, {DAY}, {rounded('rv, volume')} FROM daily")


def f4(s: SparkSession, d: str) -> DataFrame:
    m = views.macro(s, d)
    a, b = m.where("vix is not null").select("day", "vix"), m.where("epu is not null").select("day", "epu")
    return a.join(b, "day", "full")


register("f04_full_outer_alignment", f4, f"SELECT {DAY}, {rounded('vix, epu', 4)} FROM macro WHERE vix IS NOT NULL OR epu IS NOT NULL", 4)
register("f05_semi_join", lambda s, d: daily(s, d).join(views.event_days(s, d), ["instrument", "day"], "left_semi").select("instrument", "day", "rv"), f"SELECT instrument, {DAY}, round(rv, 6) AS rv FROM daily WHERE (instrument, day) IN (SELECT instrument, day FROM event_days)")


def f6(s: SparkSession, d: str) -> DataFrame:
    """Common days after one model has lost every seventh of them."""
    rows = test_forecasts(s, d).where("not (model = 'RVD' and dayofmonth(day) % 7 = 0)")
    return combine.on_common_days(rows, ["instrument"]).groupBy("instrument", "model").agg(F.count("*").alias("n"))


register("f06_common_days", f6, "SELECT instrument, model, count(*) AS n FROM test WHERE day(day) % 7 <> 0 GROUP BY 1, 2")
register("f07_model_pairs", lambda s, d: _pairs(s, d), "SELECT a.instrument, a.model AS a, b.model AS b, count(*) AS n, round(avg(a.mse - b.mse), 4) AS gap FROM losses a JOIN losses b ON a.instrument = b.instrument AND a.day = b.day AND a.model <> b.model GROUP BY 1, 2, 3", 4)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    rows = L.with_losses(test_forecasts(s, d), ["instrument", "model"])
    return inference.model_pairs(rows, ["instrument"], "mse").groupBy("instrument", "a", "b").agg(F.count("*").alias("n"), F.avg(F.col("loss_a") - F.col("loss_b")).alias("gap"))


register("f08_baseline_join", lambda s, d: L.ratios(L.mean_losses(test_forecasts(s, d), ["instrument", "model"]), "RVM", ["instrument", "loss"]), "SELECT instrument, model, loss, round(value, 5) AS value, round(ratio, 5) AS ratio FROM ratiotab", 5)


def f9(s: SparkSession, d: str) -> DataFrame:
    table = L.mean_losses(test_forecasts(s, d), ["instrument", "model"])
    fixed = table.where("loss = 'mse'").select("instrument", "model", F.col("value").alias("mse"))
    other = table.where("loss = 'qlike' and model <> 'RVD'").select("instrument", "model", F.col("value").alias("qlike"))
    return fixed.join(other, ["instrument", "model"], "left").orderBy("instrument", "model")


register("f09_left_merge_sorted", f9, "SELECT a.instrument, a.model, round(a.value, 5) AS mse, round(b.value, 5) AS qlike FROM losstab a LEFT JOIN losstab b ON a.instrument = b.instrument AND a.model = b.model AND b.loss = 'qlike' AND b.model <> 'RVD' WHERE a.loss = 'mse'", 5)


def f11(s: SparkSession, d: str) -> DataFrame:
    rows = split_features(s, d, [1])
    part = lambda x: rows.where(F.col("split") == x).select("instrument", "day", "y")
    return part("train").unionByName(part("val"))


def f10(s: SparkSession, d: str) -> DataFrame:
    """Forecasts with the regime label of their day."""
    labels = split_features(s, d, [1]).select("instrument", "day", (F.col("rvw") > F.col("rvm")).cast("int").alias("regime"))
    return test_forecasts(s, d).where("model = 'RVD'").join(labels, ["instrument", "day"]).select("instrument", "day", "regime", "y_pred")


register("f10_regime_join", f10, f"SELECT t.instrument, CAST(t.day AS VARCHAR) AS day, CAST(s.rvw > s.rvm AS INTEGER) AS regime, round(t.y_pred, 6) AS y_pred FROM test t JOIN splitted s ON s.instrument = t.instrument AND s.day = t.day AND s.horizon = 1 WHERE t.model = 'RVD'")
register("f11_union", f11, f"SELECT instrument, {DAY}, round(y, 6) AS y FROM splitted WHERE horizon = 1 AND split <> 'test'")
register("f12_intersect_distinct", lambda s, d: daily(s, d).select("day").intersect(views.macro(s, d).select("day")), f"SELECT {DAY} FROM (SELECT day FROM daily INTERSECT SELECT day FROM macro)")
register("f13_sort", lambda s, d: daily(s, d).select("instrument", "day", "rv").orderBy("instrument", "day"), f"SELECT instrument, {DAY}, round(rv, 6) AS rv FROM daily ORDER BY 1, 2")


def f14(s: SparkSession, d: str) -> DataFrame:
    table = L.mean_losses(test_forecasts(s, d), ["instrument", "model"], "qlike")
    w = Window.partitionBy("instrument").orderBy("value", "model")
    return table.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("instrument", "model", "rank", "value")


register("f14_top_k", f14, "SELECT instrument, model, CAST(rank AS INTEGER) AS rank, round(value, 5) AS value FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY value, model) AS rank FROM losstab WHERE loss = 'qlike') WHERE rank <= 2", 5)
register("f15_first_rows", lambda s, d: split_features(s, d, [1]).where("split = 'test'").withColumn("k", F.row_number().over(E.by_day())).where("k <= 300").select("instrument", "day", "k"), f"SELECT instrument, {DAY}, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM splitted WHERE horizon = 1 AND split = 'test') WHERE k <= 300")


def f16(s: SparkSession, d: str) -> DataFrame:
    table = L.mean_losses(test_forecasts(s, d), ["instrument", "model"])
    wide = table.where("loss = 'mse'").groupBy("instrument").pivot("model", ["RVD", "RVW", "RVM", "AVG3"]).agg(F.first("value"))
    return wide.unpivot("instrument", ["RVD", "RVW", "RVM", "AVG3"], "model", "value")


register("f16_pivot_unpivot", f16, "SELECT instrument, model, round(value, 5) AS value FROM losstab WHERE loss = 'mse'", 5)


def a8(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "forecasts")
    files.write_layer(forecasts(s, d), path, ("horizon", "split"))
    return files.read_layer(s, path, split="val").select("instrument", "day", "model", "y", "y_pred")


register("a08_forecast_store", a8, f"SELECT instrument, {DAY}, model, {rounded('y, y_pred')} FROM fc WHERE split = 'val'")


def a9(s: SparkSession, d: str) -> DataFrame:
    first = test_forecasts(s, d).select("instrument", "day", "model", "y_pred")
    second = first.where("model = 'RVD'").withColumn("y_pred", F.col("y_pred") + 1)
    return files.merge_runs([first, second], ["instrument", "day", "model"])


register("a09_merge_runs", a9, f"SELECT instrument, {DAY}, model, round(CASE WHEN model = 'RVD' THEN y_pred + 1 ELSE y_pred END, 6) AS y_pred FROM test")


def a9_runs(s: SparkSession, d: str) -> DataFrame:
    """One horizon of two stores, validation forecasts included, as combinations need them."""
    first = forecasts(s, d, [1, 5]).withColumn("feature_set", F.lit("M_HAR"))
    second = first.where("model = 'RVW'").withColumn("y_pred", F.col("y_pred") * 2)
    return files.merge_runs([first, second], ["instrument", "feature_set", "horizon", "split", "day", "model"], validation=True, horizon=5).where("split <> 'train'").select("instrument", "split", "day", "model", "y_pred")


register("a09_merge_with_validation", a9_runs, f"SELECT instrument, split, {DAY}, model, round(CASE WHEN model = 'RVW' THEN y_pred * 2 ELSE y_pred END, 6) AS y_pred FROM fc_all WHERE horizon = 5 AND split <> 'train'")


def a9_store(s: SparkSession, d: str) -> DataFrame:
    """A store of two runs, one of which is repeated with other forecasts for a model and horizon."""
    path = new_path(s, "store")
    first = forecasts(s, d, [1, 5]).withColumn("feature_set", F.lit("M_HAR"))
    runs.commit(first, path)
    runs.commit(first.where("model = 'RVW' and horizon = 5").withColumn("y_pred", F.col("y_pred") * 2), path)
    runs.commit(first.where("model = 'RVW' and horizon = 5").withColumn("y_pred", F.col("y_pred") * 3), path)
    return runs.read(s, path).where("split <> 'train'").select("instrument", "horizon", "split", "day", "model", "y_pred")


register("a09_committed_runs", a9_store, f"SELECT instrument, horizon, split, {DAY}, model, round(CASE WHEN model = 'RVW' AND horizon = 5 THEN y_pred * 3 ELSE y_pred END, 6) AS y_pred FROM fc_all WHERE horizon IN (1, 5) AND split <> 'train'")


def a5(s: SparkSession, d: str) -> DataFrame:
    table = L.ratios(L.mean_losses(test_forecasts(s, d), ["instrument", "model"]), "RVM", ["instrument", "loss"])
    tables = {"loss": table.where("loss = 'mse'").select("instrument", "model", "value"), "ratio": table.where("loss = 'mse'").select("instrument", "model", F.col("ratio").alias("value"))}
    path = new_path(s, "tables")
    files.write_csv(files.result_catalogue(tables), path)
    return s.read.schema("table_name string, instrument string, model string, value double").option("header", True).csv(path)


register("a05_table_catalogue_csv", a5, "SELECT 'loss' AS table_name, instrument, model, round(value, 5) AS value FROM ratiotab WHERE loss = 'mse' UNION ALL SELECT 'ratio', instrument, model, round(ratio, 5) FROM ratiotab WHERE loss = 'mse'", 5)


def a5_markdown(s: SparkSession, d: str) -> DataFrame:
    table = L.ratios(L.mean_losses(test_forecasts(s, d), ["instrument", "model"]), "RVM", ["instrument", "loss"]).where("loss = 'mse'")
    return files.markdown({"loss": table.select("instrument", "model", "value"), "ratio": table.select("instrument", "model", "ratio")})


_MARK = "SELECT '{0}' AS table_name, CAST(row_number() OVER (ORDER BY text) + 3 AS INTEGER) AS line, text FROM (SELECT '| ' || instrument || ' | ' || model || ' | ' || printf('%.3f', round({1}, 3)) || ' |' AS text FROM ratiotab WHERE loss = 'mse')"
_HEAD = "SELECT '{0}', 1, '## {0}' UNION ALL SELECT '{0}', 2, '| instrument | model | {1} |' UNION ALL SELECT '{0}', 3, '|---|---|---|'"
register("a05_markdown_catalogue", a5_markdown, " UNION ALL ".join(x.format(*n) for n in (("loss", "value"), ("ratio", "ratio")) for x in (_MARK, _HEAD)))
