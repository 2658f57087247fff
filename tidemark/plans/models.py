"""Queries of groups G and M: fitted forecasters and explanations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import explain, learners, linear, splits
from tidemark.operators import features as E
from tidemark.operators import losses as L
from tidemark.operators import measures as D
from tidemark.plans.bars import _kernel as kernel_sql
from tidemark.plans.base import daily, features, register, returns, split_features
from tidemark.plans.panel import WIDE
from tidemark.storage import cut

KEYS = ["instrument", "horizon"]
DAY = "CAST(day AS VARCHAR) AS day"
HAR = linear.HAR
GRID = linear.log_grid()
SHARES = tuple(k / 10 for k in range(1, 11))
#: Trees, boosting rounds and architectures of the production runs.
TREES = 500
ROUNDS = list(range(50, 501, 50))
NETWORKS = ["NN1", "NN2", "NN3", "NN4"]


def parts(s: SparkSession, d: str, horizons: list[int] | None = None, wide: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parted(split_features(s, d, horizons or [1], wide))


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cut(rows)  # fits read each part many times
    return tuple(rows.where(F.col("split") == x) for x in ("train", "val", "test"))


def fitted(s: SparkSession, d: str, model: str, horizons: list[int] | None = None) -> DataFrame:
    train, val, test = parts(s, d, horizons)
    return linear.forecast(train.unionByName(val), test, KEYS, model)


# Least squares on one regressor has a closed form in SQL; on three, normal equations do.
def g1(s: SparkSession, d: str) -> DataFrame:
    train, val, _ = parts(s, d, [1, 5, 22])
    return linear.ols(train.unionByName(val), KEYS, ["rvw"]).select(*KEYS, "intercept", F.col("beta")[0].alias("slope"), "sigma2", "n")


register("g01_least_squares", g1, "SELECT instrument, horizon, round(regr_intercept(y, rvw), 4) AS intercept, round(regr_slope(y, rvw), 4) AS slope, round((regr_syy(y, rvw) - pow(regr_sxy(y, rvw), 2) / regr_sxx(y, rvw)) / (count(*) - 2), 4) AS sigma2, count(*) AS n FROM splitted WHERE split <> 'test' GROUP BY 1, 2", 4)


def _three(where: str, log: bool = False, source: str = "splitted", keys: str = "instrument, horizon", tag: str = "") -> str:
    """Coefficients of y on three regressors by Cramer's rule on centred moments."""
    t = (lambda c: f"ln(greatest({c}, 1e-16))") if log else (lambda c: c)
    cols = {"a": t("rvd"), "b": t("rvw"), "c": t("rvm"), "y": t("y")}
    cov = [f"covar_pop({cols[i]}, {cols[j]}) AS c{i}{j}" for i, j in ("aa", "ab", "ac", "bb", "bc", "cc", "ay", "by", "cy", "yy")]
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    full = ["caa", "cab", "cac", "cab", "cbb", "cbc", "cac", "cbc", "ccc"]
    swap = lambda k: [("cay", "cby", "ccy")[i // 3] if i % 3 == k else c for i, c in enumerate(full)]
    return f""", mm{tag} AS (SELECT {keys}, count(*) AS nn, {", ".join(f"avg({c}) AS m{n}" for n, c in cols.items())}, {", ".join(cov)} FROM {source} WHERE {where} GROUP BY ALL),
b3{tag} AS (SELECT *, {", ".join(f"{det(swap(k))} / {det(full)} AS b{k}" for k in range(3))} FROM mm{tag}),
co{tag} AS (SELECT *, my - b0 * ma - b1 * mb - b2 * mc AS i0, (cyy - b0 * cay - b1 * cby - b2 * ccy) * nn / (nn - 4) AS s2 FROM b3{tag})"""


_LIN = "i0 + b0 * rvd + b1 * rvw + b2 * rvm"
_LOG = "exp(i0 + b0 * ln(greatest(rvd, 1e-16)) + b1 * ln(greatest(rvw, 1e-16)) + b2 * ln(greatest(rvm, 1e-16)) + s2 / 2)"


def _two_models(fit: str, ask: str, keys: str, source: str = "splitted", tag: str = "") -> str:
    """HAR and LogHAR forecasts: ({keys}, day, split, model, y, y_pred) in the table fz{tag}."""
    on = " AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    told = lambda model, pred, co: f"SELECT {', '.join(f't.{k.strip()}' for k in keys.split(','))}, day, split, '{model}' AS model, y, {pred} AS y_pred FROM {source} t JOIN {co} c ON {on} WHERE {ask}"
    return f"""{_three(fit, False, source, keys, f"h{tag}")}{_three(fit, True, source, keys, f"l{tag}")}, fz{tag} AS ({told("HAR", _LIN, f"coh{tag}")} UNION ALL {told("LogHAR", _LOG, f"col{tag}")})"""


register("g02_har", lambda s, d: fitted(s, d, "HAR", [1, 5, 22]), f"{_three(chr(39) + 'test' + chr(39) + ' <> split')} SELECT t.instrument, t.horizon, CAST(day AS VARCHAR) AS day, 'HAR' AS model, round(y, 4) AS y, round(i0 + b0 * rvd + b1 * rvw + b2 * rvm, 4) AS y_pred FROM splitted t JOIN co ON co.instrument = t.instrument AND co.horizon = t.horizon WHERE split = 'test'", 4)
register("g03_log_har", lambda s, d: fitted(s, d, "LogHAR"), f"{_three('split <> ' + chr(39) + 'test' + chr(39), log=True)} SELECT t.instrument, t.horizon, CAST(day AS VARCHAR) AS day, 'LogHAR' AS model, round(y, 4) AS y, round(exp(i0 + b0 * ln(greatest(rvd, 1e-16)) + b1 * ln(greatest(rvw, 1e-16)) + b2 * ln(greatest(rvm, 1e-16)) + s2 / 2), 4) AS y_pred FROM splitted t JOIN co ON co.instrument = t.instrument AND co.horizon = t.horizon WHERE split = 'test' AND t.horizon = 1", 4)
def _many(x: list[str], source: str, where: str, ask: str, clip: bool = False) -> str:
    """Least squares on any number of regressors by successive orthogonalisation over the fitted rows:
    each column less its projections on those before it, then y's coefficient on each."""
    w, fit = "WINDOW w AS (PARTITION BY instrument, horizon)", f"FILTER (WHERE {where})"
    steps, names = [], []
    for j, c in enumerate(x):
        sums = "".join(f", sum({c} * u{i}) {fit} OVER w / sum(u{i} * u{i}) {fit} OVER w AS c{j}_{i}" for i in range(j))
        less = "".join(f" - c{j}_{i} * u{i}" for i in range(j))
        names.append(f"s{j}")
        steps.append(f"s{j} AS (SELECT *, {c} - m{j}{less} AS u{j} FROM (SELECT *, avg({c}) {fit} OVER w AS m{j}{sums} FROM {names[j - 1] if j else source} {w}))")
    pred = " + ".join(["avg(y) {0} OVER w", *[f"sum(y * u{i}) {{0}} OVER w / sum(u{i} * u{i}) {{0}} OVER w * u{i}" for i in range(len(x))]]).format(fit)
    if clip:
        pred = f"least(greatest({pred}, min(y) {fit} OVER w), max(y) {fit} OVER w)"
    return f", {', '.join(steps)}, sp AS (SELECT *, {pred} AS y_pred FROM {names[-1]} {w}) SELECT instrument, horizon, {DAY}, '{{model}}' AS model, round(y, 4) AS y, round(y_pred, 4) AS y_pred FROM sp WHERE {ask}"


_TEST = "split = 'test' AND horizon = 1"
for _id, _m in (("g04_lev_har", "LevHAR"), ("g05_shar", "SHAR"), ("g06_harq", "HARQ")):
    register(_id, lambda s, d, m=_m: fitted(s, d, m), _many(linear.MODELS[_m], "splitted", "split <> 'test'", _TEST, clip=_m == "HARQ").replace("{model}", _m), 4)


def g7(s: SparkSession, d: str) -> DataFrame:
    train, val, test = parts(s, d, [1], wide=True)
    return linear.forecast(train.unionByName(val), test, KEYS, "HAR-X", linear.WIDE)


_WIDE_SPLIT = f"""{WIDE}, wp AS (SELECT *, 1 AS horizon, row_number() OVER (PARTITION BY instrument ORDER BY day) AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM wide),
ws AS (SELECT *, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.7 AS DOUBLE)) + floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM wp)"""
# the implied volatility is the index itself in these tables: one of the two columns has no part of its own
register("g07_har_x", g7, _WIDE_SPLIT + _many([c for c in linear.WIDE if c != "vix_lag"], "ws", "split <> 'test'", _TEST).replace("{model}", "HAR-X").replace(", 4)", ", 3)"), 3)
def standardised(rows: DataFrame) -> DataFrame:
    return linear.standardised(rows.select(*KEYS, "day", "rvd", "rvw"), rows.where("split = 'train'"), KEYS, ["rvd", "rvw"])


register("g08_standardise", lambda s, d: standardised(cut(split_features(s, d, [1]))), "SELECT s.instrument, s.horizon, CAST(day AS VARCHAR) AS day, round((rvd - md) / sd, 5) AS rvd, round((rvw - mw) / sw, 5) AS rvw FROM splitted s JOIN (SELECT instrument, avg(rvd) AS md, stddev_pop(rvd) AS sd, avg(rvw) AS mw, stddev_pop(rvw) AS sw FROM splitted WHERE split = 'train' AND horizon = 1 GROUP BY 1) t ON t.instrument = s.instrument WHERE horizon = 1", 5)
SIX = [*HAR, "rn_d", "rn_w", "rn_m"]
_soft = "sign(b / n) * greatest(abs(b / n) - {lam}, 0.0)"
_ONE = {
    "RR": "b / (a + lam)",
    "LA": _soft.format(lam="lam") + " / (a / n)",
    "EN": _soft.format(lam="lam * share") + " / (a / n + lam * (1 - share))",
    "PLA": f"CASE WHEN {_soft.format(lam='lam')} = 0 THEN 0.0 ELSE b / a END",
    "ALA": "sign(b) * greatest(abs(b * (abs(b / a) + 1e-12) / n) - lam, 0.0) / (a / n * pow(abs(b / a) + 1e-12, 2)) * (abs(b / a) + 1e-12)",
}


def _one(kind: str) -> str:
    """On one regressor every penalised fit has a closed form: the chosen point of each run, in pk."""
    shares = SHARES if kind == "EN" else (1.0,)
    moments = lambda where: f"SELECT instrument, horizon, count(*) AS n, avg(rvw) AS mx, stddev_pop(rvw) AS sx, avg(y) AS my, regr_sxx(y, rvw) / pow(stddev_pop(rvw), 2) AS a, regr_sxy(y, rvw) / stddev_pop(rvw) AS b FROM splitted WHERE horizon = 1 AND {where} GROUP BY ALL"
    return f""", m1 AS ({moments("split = 'train'")}), m2 AS ({moments("split <> 'test'")}),
gr AS (SELECT (row_number() OVER () - 1) * {len(shares)} AS first, lam FROM (SELECT unnest([{", ".join(repr(g) for g in GRID)}]) AS lam)),
pt AS (SELECT first + i - 1 AS point, lam, [{", ".join(repr(x) for x in shares)}][i] AS share FROM gr, range(1, {len(shares) + 1}) z(i)),
w1 AS (SELECT m1.*, point, lam, share, {_ONE[kind]} AS w FROM m1, pt),
ve AS (SELECT w1.instrument, w1.horizon, point, lam, share, avg(pow(y - my - w * (rvw - mx) / sx, 2)) AS val_mse FROM w1 JOIN splitted t ON t.instrument = w1.instrument AND t.horizon = w1.horizon AND t.split = 'val' GROUP BY ALL),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument, horizon ORDER BY round(val_mse, 9), point) AS place FROM ve) WHERE place = 1)"""


for _id, _m in (("g09_ridge", "RR"), ("g10_lasso", "LA"), ("g11_elastic_net", "EN"), ("g12_post_lasso", "PLA"), ("g13_adaptive_lasso", "ALA")):
    _s = SHARES if _m == "EN" else (1.0,)
    register(_id, lambda s, d, m=_m, v=_s: linear.penalised_forecast(*parts(s, d), KEYS, SIX, m, GRID, v))
    register(
        f"{_id}_one_regressor", lambda s, d, m=_m, v=_s: linear.penalised_forecast(*parts(s, d), KEYS, ["rvw"], m, GRID, v),
        f"{_one(_m)}, w2 AS (SELECT m2.*, lam, {_ONE[_m]} AS w FROM m2 JOIN pk USING (instrument, horizon)) SELECT t.instrument, t.horizon, {DAY}, '{_m}' AS model, round(y, 3) AS y, round(my + w * (rvw - mx) / sx, 3) AS y_pred FROM splitted t JOIN w2 ON w2.instrument = t.instrument AND w2.horizon = t.horizon WHERE split = 'test'".replace("JOIN pk USING (instrument, horizon)", "JOIN pk ON pk.instrument = m2.instrument AND pk.horizon = m2.horizon"), 3,
    )


def g14(s: SparkSession, d: str, x: list[str] | None = None) -> DataFrame:
    train, val, _ = parts(s, d)
    made = [linear.select_penalty(train, val, KEYS, x or SIX, m, GRID, SHARES if m == "EN" else (1.0,)).withColumn("model", F.lit(m)) for m in ("RR", "LA", "EN")]
    return reduce(DataFrame.unionByName, made)


register("g14_selected_penalties", g14)
register("g14_selected_one_regressor", lambda s, d: g14(s, d, ["rvw"]).where("model = 'RR'").select(*KEYS, "lam", "interior", "val_mse"), f"{_one('RR')} SELECT instrument, horizon, round(lam, 4) AS lam, lam > {min(GRID)!r} AND lam < {max(GRID)!r} AS interior, round(val_mse, 4) AS val_mse FROM pk", 4)
register("g15_bagging", lambda s, d: learners.forest(split_features(s, d, [1]), KEYS, HAR, TREES, None, "BG"))
register("g16_random_forest", lambda s, d: learners.forest(split_features(s, d, [1]), KEYS, HAR, TREES, 1, "RF"))
register("g17_gradient_boosting", lambda s, d: learners.boosting(split_features(s, d, [1]), KEYS, HAR, ROUNDS, [0.01, 0.1], [1, 2]))


def networks(s: SparkSession, d: str) -> DataFrame:
    return learners.networks(split_features(s, d, [1]), KEYS, HAR, NETWORKS)


register("g18_network_ensemble", networks)
register("g19_best_network", lambda s, d: networks(s, d).where("model like '%^1'"))


def g20(s: SparkSession, d: str) -> DataFrame:
    train, val, test = parts(s, d, [1, 5, 22])
    fit = linear.forecast(train.unionByName(val), test, KEYS, "W", ["rvw"])
    return L.mean_losses(fit, [*KEYS, "model"], "mse")


register("g20_fixed_window", g20, "SELECT s.instrument, s.horizon, 'W' AS model, 'mse' AS loss, round(avg(pow(y - i0 - b0 * rvw, 2)), 4) AS value FROM splitted s JOIN (SELECT instrument, horizon, regr_intercept(y, rvw) AS i0, regr_slope(y, rvw) AS b0 FROM splitted WHERE split <> 'test' GROUP BY 1, 2) c ON c.instrument = s.instrument AND c.horizon = s.horizon WHERE split = 'test' GROUP BY 1, 2", 4)


def rolled(s: SparkSession, d: str, window: int | None, refit: int = 1) -> DataFrame:
    return linear.rolling_forecast(split_features(s, d, [1]), KEYS, ["rvw"], window, refit)


def _rolled(frame: str) -> str:
    return f"SELECT instrument, horizon, {DAY}, round(y, 4) AS y, round(i0 + b0 * rvw, 4) AS y_pred FROM (SELECT *, regr_intercept(y, rvw) OVER w AS i0, regr_slope(y, rvw) OVER w AS b0 FROM splitted WHERE horizon = 1 WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING)) WHERE split = 'test'"


register("g21_rolling_window", lambda s, d: rolled(s, d, 1000), _rolled("1000"), 4)
register("g22_expanding_window", lambda s, d: rolled(s, d, None), _rolled("UNBOUNDED"), 4)
register(
    "g21_rolling_refit_monthly", lambda s, d: rolled(s, d, 1000, 22),
    f"""{", rf"} AS (SELECT *, regr_intercept(y, rvw) OVER w AS i0, regr_slope(y, rvw) OVER w AS b0, row_number() OVER (PARTITION BY instrument, split ORDER BY rn) - 1 AS k FROM splitted WHERE horizon = 1 WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING))
SELECT t.instrument, t.horizon, CAST(t.day AS VARCHAR) AS day, round(t.y, 4) AS y, round(f.i0 + f.b0 * t.rvw, 4) AS y_pred FROM rf t JOIN rf f ON f.instrument = t.instrument AND f.rn = t.rn - t.k % 22 WHERE t.split = 'test'""", 4,
)


# --- the whole HAR family ------------------------------------------------------------------------

NARROW = list(dict.fromkeys(c for x in linear.MODELS.values() for c in x))
_LOGGED = [f"l_{c}" for c in [*HAR, "y"]]
_logs = lambda source: f"SELECT *, {', '.join(f'ln(greatest({c[2:]}, 1e-16)) AS {c}' for c in _LOGGED)} FROM {source}"


def _centred(columns: list[str], of: str = "") -> str:
    """Moments of a group of rows: count, means, centred products, ends of the target."""
    pairs = [f"covar_pop({of}{a}, {of}{b}) AS v_{a}_{b}" for i, a in enumerate(columns) for b in columns[i:]]
    return ", ".join(["count(*) AS nn", f"min({of}y) AS lo", f"max({of}y) AS hi", *[f"avg({of}{c}) AS m_{c}" for c in columns], *pairs])


def _solved(tag: str, source: str, columns: list[str], keys: str, x: list[str], y: str = "y") -> str:
    """Least squares of y on x from the moments in ``source``, by elimination: the table cf{tag}."""
    p, own, place = len(x), [*x, y], {c: i for i, c in enumerate(columns)}
    told = lambda a, b: f"v_{a}_{b}" if place[a] <= place[b] else f"v_{b}_{a}"
    steps = [f"e{tag}_0 AS (SELECT {keys}, nn, lo, hi, {', '.join(f'm_{c} AS m{i}' for i, c in enumerate(own))}, {', '.join(f'{told(own[i], own[j])} AS a{i}_{j}' for i in range(p + 1) for j in range(i, p + 1))} FROM {source})"]
    for k in range(p):
        steps.append(f"e{tag}_{k + 1} AS (SELECT * REPLACE ({', '.join(f'a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}' for i in range(k + 1, p + 1) for j in range(i, p + 1))}) FROM e{tag}_{k})")
    before = f"e{tag}_{p}"
    for i in reversed(range(p)):
        less = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, p))
        steps.append(f"f{tag}_{i} AS (SELECT *, (a{i}_{p}{less}) / a{i}_{i} AS b{i} FROM {before})")
        before = f"f{tag}_{i}"
    start = f"m{p}" + "".join(f" - b{i} * m{i}" for i in range(p))
    return ", ".join([*steps, f"cf{tag} AS (SELECT *, {start} AS i0, a{p}_{p} * nn / (nn - {p + 1}) AS s2 FROM {before})"])


def _family(source: str, moments: str, columns: list[str], keys: str, models: dict[str, list[str]], ask: str, name: str, tag: str = "") -> str:
    """Forecasts of all models from the moments of each key, in the table ``name``."""
    fits, parts = [], []
    on = " AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    for i, (model, x) in enumerate(models.items()):
        own = [f"l_{c}" for c in x] if model == "LogHAR" else x
        fits.append(_solved(f"{tag}{i}", moments, columns, keys, own, "l_y" if model == "LogHAR" else "y"))
        line = "i0" + "".join(f" + b{j} * t.{c}" for j, c in enumerate(own))
        guess = {"LogHAR": f"exp({line} + s2 / 2)", "HARQ": f"least(greatest({line}, lo), hi)"}.get(model, line)
        parts.append(f"SELECT t.*, '{model}' AS model, {guess} AS y_pred FROM {source} t JOIN cf{tag}{i} c ON {on} WHERE {ask}")
    return f"{', '.join(fits)}, {name} AS ({' UNION ALL BY NAME '.join(parts)})"


def _rolled_family(rows: str, columns: list[str], models: dict[str, list[str]], embargo: str = "0") -> str:
    """The same on windows as long as train and val, refitted each day: the table fr."""
    window = f"h.rn BETWEEN t.rn - nf - ({embargo}) AND t.rn - 1 - ({embargo})"
    moments = f"""nf AS (SELECT instrument, horizon, count(*) AS nf FROM {rows} WHERE split <> 'test' GROUP BY 1, 2),
mr AS MATERIALIZED (SELECT t.instrument, t.horizon, t.day, {_centred(columns, "h.")} FROM {rows} t JOIN nf ON nf.instrument = t.instrument AND nf.horizon = t.horizon
  JOIN {rows} h ON h.instrument = t.instrument AND h.horizon = t.horizon AND {window} WHERE t.split = 'test' GROUP BY 1, 2, 3)"""
    return f"{moments}, {_family(rows, 'mr', columns, 'instrument, horizon, day', models, 't.split = ' + chr(39) + 'test' + chr(39), 'fr', 'r')}"


_FAMILY = linear.FAMILY
_NARROW = [*NARROW, *_LOGGED, "y"]
_LG = f", lg AS ({_logs('splitted')}), "
_FORECASTS = f"SELECT instrument, horizon, {DAY}, model, round(y, 4) AS y, round(y_pred, 4) AS y_pred FROM fr"


def rolling_family(s: SparkSession, d: str, embargo: bool = False) -> DataFrame:
    return linear.rolling_models(split_features(s, d), KEYS, _FAMILY, embargo=F.col("horizon") - 1 if embargo else 0)


register("g21_rolling_har_family", rolling_family, _LG + _rolled_family("lg", _NARROW, _FAMILY) + _FORECASTS, 4)
register("g21_rolling_har_embargo", lambda s, d: rolling_family(s, d, True), _LG + _rolled_family("lg", _NARROW, _FAMILY, "t.horizon - 1") + _FORECASTS, 4)

# the wide set at all horizons; of the two equal columns SQL keeps one
_WIDE_X = [c for c in linear.WIDE if c != "vix_lag"]
_WIDE_ALL = WIDE.replace("wide AS (SELECT w1.instrument, w1.day,", "wide AS (SELECT w1.instrument, w1.day, f.horizon,").replace(" AND f.horizon = 1", "")
_WIDE_ALL += f""", wp AS (SELECT *, row_number() OVER (PARTITION BY instrument, horizon ORDER BY day) AS rn, count(*) OVER (PARTITION BY instrument, horizon) AS n FROM wide),
wl AS (SELECT *, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.7 AS DOUBLE)) + floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM wp), """


def rolling_wide(s: SparkSession, d: str) -> DataFrame:
    return linear.rolling_models(split_features(s, d, wide=True), KEYS, {"HAR-X": linear.WIDE})


register("g21_rolling_har_x", rolling_wide, _WIDE_ALL + _rolled_family("wl", [*_WIDE_X, "y"], {"HAR-X": _WIDE_X}) + _FORECASTS.replace(", 4)", ", 3)"), 3)


def linear_panel(rows: DataFrame, models: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Test forecasts refitted each day on a window as long as train and val, val forecasts from train
    alone: (keys, day, split, model, y, y_pred)."""
    test = linear.rolling_models(rows, keys, models).withColumn("split", F.lit("test"))
    return test.unionByName(linear.fixed_models(rows, keys, models).where("split = 'val'"))


def g23(s: SparkSession, d: str) -> DataFrame:
    """The lag models of all horizons on the short set and the wide model, with their validation forecasts."""
    days = daily(s, d)
    split = lambda wide: cut(split_features(s, d, wide=wide, panel=days))
    panel = linear_panel(split(False), _FAMILY, KEYS).unionByName(linear_panel(split(True), {"HAR-X": linear.WIDE}, KEYS))
    return L.mean_losses(panel, [*KEYS, "split", "model"], "mse")


def _fixed_family(rows: str, fit: str, ask: str, name: str, tag: str, columns: list[str] = _NARROW, models: dict[str, list[str]] = _FAMILY, keys: str = "instrument, horizon") -> str:
    return f"mf{tag} AS (SELECT {keys}, {_centred(columns)} FROM {rows} WHERE {fit} GROUP BY ALL), {_family(rows, f'mf{tag}', columns, keys, models, ask, name, tag)}"


_MSE = "'mse' AS loss, round(avg((y - y_pred) * (y - y_pred)), 3) AS value"
_PARTS = ("split = 'train'", "t.split = 'val'"), ("split <> 'test'", "t.split = 'test'")
_told = lambda t: f"SELECT instrument, horizon, split, model, y, y_pred FROM {t}"
register("g23_linear_panel", g23, f"""{_LG}{_rolled_family("lg", _NARROW, _FAMILY)}, {_fixed_family("lg", *_PARTS[0], "fv", "v")}{_WIDE_ALL.rstrip(", ")},
{_rolled_family("wl", [*_WIDE_X, "y"], {"HAR-X": _WIDE_X}).replace("nf AS", "nfx AS").replace("JOIN nf ON nf.", "JOIN nfx AS nf ON nf.").replace("mr AS", "mrx AS").replace("FROM mr)", "FROM mrx)").replace("er0", "ex0").replace("fr0", "fx0").replace("cfr0", "cfx0").replace("fr AS", "frx AS")},
{_fixed_family("wl", *_PARTS[0], "fvx", "vx", [*_WIDE_X, "y"], {"HAR-X": _WIDE_X})}
SELECT instrument, horizon, split, model, {_MSE} FROM ({" UNION ALL ".join(map(_told, ("fr", "fv", "frx", "fvx")))}) GROUP BY 1, 2, 3, 4""", 3)


def panel_forecasts(rows: DataFrame) -> DataFrame:
    """Every model of a run, with validation forecasts: (instrument, horizon, day, split, model, y,
    y_pred), floored at the least training target. Penalised models and trees forecast val after the
    refit on train and val, networks are trained on train."""
    train, val, rest = rows.where("split = 'train'"), rows.where("split = 'val'"), rows.where("split <> 'train'")
    columns = [*KEYS, "day", "split", "model", "y", "y_pred"]
    made = [linear_panel(rows, _FAMILY, KEYS)]
    split_of = rest.select(*KEYS, "day", "split")
    for kind in linear.PENALISED:
        made.append(linear.penalised_forecast(train, val, rest, KEYS, HAR, kind, GRID, SHARES if kind == "EN" else (1.0,)).join(split_of, [*KEYS, "day"]))
    made += [learners.forest(rows, KEYS, HAR, TREES, tried, name) for name, tried in (("BG", None), ("RF", 1))]
    made.append(learners.boosting(rows, KEYS, HAR, ROUNDS, [0.01, 0.1], [1, 2]))
    made.append(learners.networks(rows, KEYS, HAR, NETWORKS))
    table = cut(reduce(DataFrame.unionByName, [m.select(*columns) for m in made]))  # losses read it twice
    return splits.floored(table, train, KEYS)


def g23_all(s: SparkSession, d: str) -> DataFrame:
    return L.mean_losses(panel_forecasts(cut(split_features(s, d, [1]))), [*KEYS, "split", "model"])


register("g23_panel_run", g23_all)


def g24(s: SparkSession, d: str) -> DataFrame:
    """The date split, fixed window, with validation forecasts: the lag models and the wide model."""
    days = daily(s, d)
    dated = lambda wide: splits.by_date(features(s, d, wide=wide, panel=days), KEYS, "1997-12-31", "1998-06-30")
    panel = linear.fixed_models(dated(False), KEYS, _FAMILY).unionByName(linear.fixed_models(dated(True), KEYS, {"HAR-X": linear.WIDE}))
    return L.mean_losses(panel, [*KEYS, "split", "model"], "mse")


_BY_DATE = "CASE WHEN day <= DATE '1997-12-31' THEN 'train' WHEN day <= DATE '1998-06-30' THEN 'val' ELSE 'test' END AS split"
_X = [*_WIDE_X, "y"], {"HAR-X": _WIDE_X}
register("g24_date_split_run", g24, f"""{_WIDE_ALL.rstrip(", ")}, lg AS (SELECT *, {_BY_DATE} FROM ({_logs('feats')})), wd AS (SELECT *, {_BY_DATE} FROM wide),
{", ".join([_fixed_family("lg", *p, f"fz{i}", f"z{i}") for i, p in enumerate(_PARTS)])}, {", ".join([_fixed_family("wd", *p, f"fy{i}", f"y{i}", *_X) for i, p in enumerate(_PARTS)])}
SELECT instrument, horizon, split, model, {_MSE} FROM ({" UNION ALL ".join(map(_told, ("fz0", "fz1", "fy0", "fy1")))}) GROUP BY 1, 2, 3, 4""", 3)


def g25(s: SparkSession, d: str) -> DataFrame:
    """Training sizes and horizons as grouping columns of a single job, all lag models."""
    sized = features(s, d).withColumn("size", F.explode(F.array(*[F.lit(n) for n in (800, 1000, 1200, 1500)])))
    keys = [*KEYS, "size"]
    w = Window.partitionBy(*keys)
    placed = sized.withColumn("rn", F.row_number().over(w.orderBy("day"))).withColumn("n", F.count("*").over(w)).where("n > size + 200")
    split = F.when(F.col("rn") <= F.col("size"), "train").when(F.col("rn") <= F.col("size") + 200, "val").otherwise("test")
    return L.mean_losses(linear.fixed_models(placed.withColumn("split", split), keys, _FAMILY).where("split = 'test'"), [*keys, "model"], "mse")


register("g25_training_sizes", g25, f""", sz AS (SELECT p.*, z.size, CASE WHEN rn <= z.size + 200 THEN 'fit' ELSE 'test' END AS split FROM placed p, (SELECT unnest([800, 1000, 1200, 1500]) AS size) z WHERE n > z.size + 200),
lg AS ({_logs('sz')}), {_fixed_family("lg", "split = 'fit'", "t.split = 'test'", "fz", "s", keys="instrument, horizon, size")}
SELECT instrument, horizon, size, model, {_MSE} FROM fz GROUP BY 1, 2, 3, 4""", 3)


def g26(s: SparkSession, d: str) -> DataFrame:
    """Trees fitted once against trees refitted for every test row on the window of the same length that
    ends before it; boosting keeps the settings of one tuning. Ratios to HAR."""
    rows = cut(split_features(s, d, [1]))
    settings = learners.tuned_boosting(rows, KEYS, HAR, ROUNDS, [0.01, 0.1], [1, 2])
    made = {
        "fixed": [learners.forest(rows, KEYS, HAR, TREES, 1, "RF"), learners.boosted(rows, KEYS, HAR, settings)],
        "rolling": [learners.rolling_forest(rows, KEYS, HAR, TREES, 1, "RF"), learners.rolling_boosted(rows, KEYS, HAR, settings)],
    }
    columns = [*KEYS, "day", "model", "y", "y_pred"]
    trees = cut(reduce(DataFrame.unionByName, [m.where("split = 'test'").select(*columns, F.lit(scheme).alias("scheme")) for scheme, both in made.items() for m in both]))
    fixed = linear.forecast(rows.where("split <> 'test'"), rows.where("split = 'test'"), KEYS, "HAR")
    har = L.mean_losses(fixed, KEYS, "mse").select(*KEYS, F.col("value").alias("base"))
    floors = splits.floored(trees, rows.where("split = 'train'"), KEYS)
    return L.mean_losses(floors, [*KEYS, "model", "scheme"], "mse").join(har, KEYS).withColumn("ratio", F.col("value") / F.col("base")).drop("base", "loss")


register("g26_rolling_trees", g26)


def measured(tables: dict[str, DataFrame], horizons: list[int], models: list[str]) -> DataFrame:
    """(instrument, measure, horizon, model, mse): the lag models on each of several daily series."""
    long = reduce(DataFrame.unionByName, [df.select(F.struct("instrument", F.lit(name).alias("measure")).alias("instrument"), "day", "rv") for name, df in tables.items()])
    lags = [c.alias(n) for n, c in E.har_lags().items()]
    made = reduce(DataFrame.unionByName, [long.select("instrument", "day", *lags, E.target(h).alias("y")).na.drop(subset=["rvd", "rvw", "rvm", "y"]).withColumn("horizon", F.lit(h)) for h in horizons])
    split = splits.by_fraction(made.select("instrument.*", *[c for c in made.columns if c != "instrument"]), ["instrument", "measure", "horizon"])
    keys = ["instrument", "measure", "horizon"]
    fits = [linear.forecast(split.where("split <> 'test'"), split.where("split = 'test'"), keys, m, ["rvw"] if m == "W" else None) for m in models]
    return L.mean_losses(reduce(DataFrame.unionByName, fits), [*keys, "model"], "mse").withColumnRenamed("value", "mse").drop("loss")


def _measured(tables: dict[str, str]) -> str:
    """The same in SQL, up to the split table ms."""
    over = "OVER (PARTITION BY instrument, measure ORDER BY day ROWS BETWEEN {} AND {})"
    full = lambda a, b, n: f"CASE WHEN count(rv) {over.format(a, b)} = {n} THEN avg(rv) {over.format(a, b)} END"
    target = lambda h: full("CURRENT ROW", f"{h - 1} FOLLOWING" if h > 1 else "CURRENT ROW", h)
    return f""", ml AS ({" UNION ALL ".join(f"SELECT instrument, '{n}' AS measure, day, {v} AS rv FROM {t}" for n, (t, v) in tables.items())}),
m0 AS (SELECT instrument, measure, day, lag(rv) OVER (PARTITION BY instrument, measure ORDER BY day) AS rvd, {full("5 PRECEDING", "1 PRECEDING", 5)} AS rvw, {full("22 PRECEDING", "1 PRECEDING", 22)} AS rvm, {target(1)} AS y1, {target(5)} AS y5, {target(22)} AS y22 FROM ml),
mh AS (SELECT instrument, measure, horizon, day, rvd, rvw, rvm, y FROM ({" UNION ALL ".join(f"SELECT *, {h} AS horizon, y{h} AS y FROM m0" for h in (1, 5, 22))}) WHERE y IS NOT NULL AND rvm IS NOT NULL),
mp AS (SELECT *, row_number() OVER (PARTITION BY instrument, measure, horizon ORDER BY day) AS rn, count(*) OVER (PARTITION BY instrument, measure, horizon) AS n FROM mh),
ms AS (SELECT *, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.7 AS DOUBLE)) + floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE)) THEN 'fit' ELSE 'test' END AS split FROM mp)"""


def g27(s: SparkSession, d: str) -> DataFrame:
    """HAR and LogHAR on variance and on the realised kernel, all horizons, as logarithms: a kernel can
    be 0, and a log model's error is then beyond all measure."""
    tables = {"rv": daily(s, d), "rk": D.realised_kernel(returns(s, d), "seq").withColumnRenamed("rk", "rv")}
    found = measured(tables, [1, 5, 22], ["HAR", "LogHAR"])
    wide = found.groupBy(*KEYS, "model").pivot("measure", ["rv", "rk"]).agg(F.first("mse"))
    return wide.select(*KEYS, "model", F.log("rv").alias("log_mse_rv"), F.log("rk").alias("log_mse_rk"), F.log(F.col("rk") / F.col("rv")).alias("log_ratio"))


register("g27_kernel_robustness", g27, f""", {kernel_sql("tr", "seq")}{_measured({"rv": ("daily", "rv"), "rk": ("rk", "rk")})}{_two_models("split = 'fit'", "split = 'test'", "instrument, measure, horizon", "ms")},
er AS (SELECT instrument, measure, horizon, model, avg((y - y_pred) * (y - y_pred)) AS mse FROM fz GROUP BY 1, 2, 3, 4)
SELECT a.instrument, a.horizon, a.model, round(ln(a.mse), 4) AS log_mse_rv, round(ln(b.mse), 4) AS log_mse_rk, round(ln(b.mse / a.mse), 4) AS log_ratio FROM er a JOIN er b ON a.instrument = b.instrument AND a.horizon = b.horizon AND a.model = b.model AND a.measure = 'rv' AND b.measure = 'rk'""", 4)


def g28(s: SparkSession, d: str) -> DataFrame:
    """Variance against kernel at two samplings of the trades (all, every second)."""
    rows = returns(s, d)
    half = B.with_returns(rows.where("seq % 2 = 1").drop("r"), "seq")
    kernel = lambda r: D.realised_kernel(r, "seq").withColumnRenamed("rk", "rv")
    tables = {"rv_1": D.daily_realised(rows, "seq"), "rk_1": kernel(rows), "rv_2": D.daily_realised(half, "seq"), "rk_2": kernel(half)}
    wide = measured(tables, [1], ["W"]).groupBy("instrument").pivot("measure", list(tables)).agg(F.first("mse"))
    ratios = {"freq_effect": ("rv_1", "rv_2"), "estimator_effect": ("rk_2", "rv_2"), "kernel_helps": ("rk_1", "rv_1"), "combined": ("rk_1", "rv_2")}
    return wide.select("*", *[(F.col(a) / F.col(b)).alias(n) for n, (a, b) in ratios.items()])


_HALF = "th AS (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY instrument, day ORDER BY seq) AS r FROM trades WHERE seq % 2 = 1), dh AS (SELECT instrument, day, coalesce(sum(r * r), 0.0) AS rv FROM th GROUP BY 1, 2 HAVING count(*) >= 2)"
_second = kernel_sql("th", "seq")
for _t in ("bw0", "bw", "pos", "cov", "rk"):
    _second = re.sub(rf"\b{_t}\b", f"{_t}h", _second)
register("g28_frequency_estimator", g28, f""", {kernel_sql("tr", "seq")}, {_HALF}, {_second}{_measured({"rv_1": ("daily", "rv"), "rk_1": ("rk", "rk"), "rv_2": ("dh", "rv"), "rk_2": ("rkh", "rkh")})},
cf AS (SELECT instrument, measure, regr_intercept(y, rvw) AS i0, regr_slope(y, rvw) AS b0 FROM ms WHERE horizon = 1 AND split = 'fit' GROUP BY 1, 2),
er AS (SELECT t.instrument, t.measure, avg(pow(y - i0 - b0 * rvw, 2)) AS e FROM ms t JOIN cf ON cf.instrument = t.instrument AND cf.measure = t.measure WHERE horizon = 1 AND split = 'test' GROUP BY 1, 2),
wd AS (SELECT instrument, {", ".join(f"max(CASE WHEN measure = '{m}' THEN e END) AS {m}" for m in ("rv_1", "rk_1", "rv_2", "rk_2"))} FROM er GROUP BY 1)
SELECT instrument, {", ".join(f"round({m}, 3) AS {m}" for m in ("rv_1", "rk_1", "rv_2", "rk_2"))}, round(rv_1 / rv_2, 3) AS freq_effect, round(rk_2 / rv_2, 3) AS estimator_effect, round(rk_1 / rv_1, 3) AS kernel_helps, round(rk_1 / rv_2, 3) AS combined FROM wd""", 3)
def g29(s: SparkSession, d: str) -> DataFrame:
    """In-sample (train and val) coefficients of the lag model and the wide one, without its second copy of the index."""
    rows = split_features(s, d, wide=True).where("split <> 'test'")
    return reduce(DataFrame.unionByName, [linear.coefficient_table(rows, KEYS, x).withColumn("model", F.lit(m)) for m, x in (("HAR", HAR), ("HAR-X", _WIDE_X))])


def _robust(tag: str, model: str, x: list[str]) -> str:
    """Each regressor's residual on the others gives its coefficient and its robust error."""
    keys, columns = "instrument, horizon", [*_WIDE_X, "y"]
    line = lambda t, cols: f"{t}.i0" + "".join(f" + {t}.b{j} * r.{c}" for j, c in enumerate(cols))
    out = [_solved(f"{tag}m", "mi", columns, keys, x), f"u{tag} AS (SELECT r.*, y - ({line('c', x)}) AS u FROM wi r JOIN cf{tag}m c ON c.instrument = r.instrument AND c.horizon = r.horizon)"]
    parts = []
    for i, c in enumerate(x):
        others = [o for o in x if o != c]
        out.append(_solved(f"{tag}{i}", "mi", columns, keys, others, c))
        parts.append(f"SELECT r.instrument, r.horizon, '{c}' AS term, r.u, r.y, r.{c} - ({line('c', others)}) AS e FROM u{tag} r JOIN cf{tag}{i} c ON c.instrument = r.instrument AND c.horizon = r.horizon")
    out.append(f"t{tag} AS (SELECT instrument, horizon, '{model}' AS model, term, sum(e * y) / sum(e * e) AS coefficient, sum(e * y) / sqrt(sum(u * u * e * e)) AS robust_t FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 4)")
    return ", ".join(out)


register("g29_coefficients", lambda s, d: g29(s, d).where("term <> 'const'").withColumn("robust_t", F.round("robust_t", 3)), f"""{_WIDE_ALL}wi AS (SELECT * FROM wl WHERE split <> 'test'), mi AS (SELECT instrument, horizon, {_centred([*_WIDE_X, "y"])} FROM wi GROUP BY 1, 2),
{_robust("h", "HAR", HAR)}, {_robust("x", "HAR-X", _WIDE_X)} SELECT instrument, horizon, model, term, round(coefficient, 6) + 0 AS coefficient, round(robust_t, 3) + 0 AS robust_t FROM (SELECT * FROM th UNION ALL SELECT * FROM tx)""", 6)

# --- explanations --------------------------------------------------------------------------------

WEIGHTS = {"rvd": 0.5, "rvw": 0.3, "rvm": 0.2}


def score(x: dict):
    """A fixed linear rule, so that effects have an exact SQL form."""
    return reduce(lambda a, b: a + b, [F.lit(w) * x[c] for c, w in WEIGHTS.items()])


RULE = explain.by_column(score, HAR)
BINS = 40


def effects(s: SparkSession, d: str) -> DataFrame:
    return explain.all_effects(parts(s, d)[2], ["instrument"], RULE, HAR, BINS)


def _ale(c: str) -> str:
    qs = ", ".join(f"CAST({i / BINS} AS DOUBLE)" for i in range(BINS + 1))
    return f"""SELECT instrument, '{c}' AS feature, CAST(b AS INTEGER) AS bin, edges[b] AS low, edges[b + 1] AS high, {WEIGHTS[c]} * (edges[b + 1] - edges[1]) AS total, n FROM (
SELECT e.instrument, edges, len(list_filter(edges[2:{BINS}], lambda q: q <= {c})) + 1 AS b, count(*) AS n FROM xs JOIN (SELECT instrument, list_distinct_sorted AS edges FROM (SELECT instrument, quantile_cont({c}, [{qs}]) AS list_distinct_sorted FROM xs GROUP BY 1)) e ON e.instrument = xs.instrument GROUP BY ALL)"""


_ALE = f""", xs AS (SELECT * FROM splitted WHERE horizon = 1 AND split = 'test'), al0 AS ({" UNION ALL ".join(_ale(c) for c in HAR)}),
al AS (SELECT instrument, feature, bin, low, high, total - sum(total * n) OVER (PARTITION BY instrument, feature) / sum(n) OVER (PARTITION BY instrument, feature) AS ale, n FROM al0),
vi AS (SELECT instrument, feature, raw / sum(raw) OVER (PARTITION BY instrument) AS vi FROM (SELECT instrument, feature, sqrt(sum(ale * ale * n) / sum(n)) AS raw FROM al GROUP BY 1, 2))"""
register("m01_local_effects", effects, f"{_ALE} SELECT instrument, feature, bin, round(low, 4) AS low, round(high, 4) AS high, round(ale, 4) AS ale, n FROM al", 4)
register("m02_variable_importance", lambda s, d: explain.importance(effects(s, d), ["instrument"]), f"{_ALE} SELECT instrument, feature, round(vi, 5) AS vi FROM vi", 5)


def forest_of(rows: DataFrame) -> explain.Predict:
    models = learners.grown_forest(rows, KEYS, HAR, TREES, 1)
    return lambda points: learners.forest_scores(points, KEYS, HAR, models)


def m3(s: SparkSession, d: str) -> DataFrame:
    """Importance for fitted models: linear ones as columns of joined coefficients, the forest by
    scoring both ends of each row's bin."""
    rows = cut(split_features(s, d, [1]))
    fit, test = rows.where("split <> 'test'"), rows.where("split = 'test'")
    out = [explain.importance(explain.all_effects(test, KEYS, forest_of(rows), HAR, BINS), KEYS).withColumn("model", F.lit("RF"))]
    for name in ("HAR", "LevHAR"):
        x = linear.MODELS[name]
        scored = test.join(linear.ols(fit, KEYS, x).select(*KEYS, "intercept", "beta"), KEYS)
        line = explain.by_column(lambda v, x=x: reduce(lambda a, b: a + b, [F.col("beta")[i] * v[c] for i, c in enumerate(x)]), x)
        out.append(explain.importance(explain.all_effects(scored, KEYS, line, x, BINS), KEYS).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


register("m03_importance_grid", m3)


def shares(train: DataFrame, test: DataFrame, predict: explain.Predict) -> DataFrame:
    """Shapley shares of the test rows against the training means."""
    return explain.shapley_shares(test, KEYS, predict, HAR, train, 6)


def first_rows(test: DataFrame) -> DataFrame:
    """The 300 rows of an instrument that the SQL of the linear rule explains."""
    return test.withColumn("k", F.row_number().over(E.by_day())).where("k <= 300").drop("k")


def forest_shares(s: SparkSession, d: str) -> DataFrame:
    rows = cut(split_features(s, d, [1]))
    return shares(rows.where("split = 'train'"), rows.where("split = 'test'"), forest_of(rows))


def rule_shares(s: SparkSession, d: str) -> DataFrame:
    train, _, test = parts(s, d)
    return shares(train, first_rows(test), RULE)


# the forest has no SQL form; under a linear rule a Shapley value is the weight times the distance from the mean
_SHAP = f"""sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM xs) WHERE k <= 300),
sm AS (SELECT instrument, {", ".join(f"avg({c}) AS m_{c}" for c in HAR)} FROM splitted WHERE horizon = 1 AND split = 'train' GROUP BY 1),
sz AS ({" UNION ALL ".join(f"SELECT sr.instrument, '{c}' AS feature, avg(abs({w} * ({c} - m_{c}))) AS size FROM sr JOIN sm ON sm.instrument = sr.instrument GROUP BY 1" for c, w in WEIGHTS.items())}),
sh AS (SELECT instrument, feature, size / sum(size) OVER (PARTITION BY instrument) AS share FROM sz)"""
register("m06_shapley_shares", forest_shares)
register("m06_shapley_linear_rule", lambda s, d: rule_shares(s, d).drop("horizon"), f"{_ALE}, {_SHAP} SELECT instrument, feature, round(share, 5) AS share FROM sh", 5)


def m7(s: SparkSession, d: str) -> DataFrame:
    rows = cut(split_features(s, d, [1]))
    predict, train, test = forest_of(rows), rows.where("split = 'train'"), rows.where("split = 'test'")
    return explain.compared(explain.importance(explain.all_effects(test, KEYS, predict, HAR, BINS), KEYS), shares(train, test, predict), KEYS)


def m7_rule(s: SparkSession, d: str) -> DataFrame:
    train, _, test = parts(s, d)
    return explain.compared(explain.importance(explain.all_effects(test, ["instrument"], RULE, HAR, BINS), ["instrument"]), shares(train, first_rows(test), RULE), ["instrument"])


register("m07_effects_against_shapley", m7)
register("m07_compared_linear_rule", m7_rule, f"""{_ALE}, {_SHAP},
rr AS (SELECT vi.instrument, vi.feature, vi, share, row_number() OVER (PARTITION BY vi.instrument ORDER BY vi) AS ra, row_number() OVER (PARTITION BY vi.instrument ORDER BY share) AS rb FROM vi JOIN sh ON sh.instrument = vi.instrument AND sh.feature = vi.feature)
SELECT instrument, round(corr(ra, rb), 5) AS spearman, arg_max(feature, vi) AS top_vi, arg_max(feature, share) AS top_share FROM rr GROUP BY 1""", 5)
