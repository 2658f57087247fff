"""Queries of groups H to L: combinations, losses, inference, conditional evaluation, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import combine, conditional, inference, risk
from tidemark.operators import losses as L
from tidemark.plans.base import daily, forecasts, register, rounded, split_features, test_forecasts

DAY = "CAST(day AS VARCHAR) AS day"
IM = ["instrument", "model"]
#: Bootstrap draws of intervals, and of confidence sets.
DRAWS, SET_DRAWS = 5000, 10_000


def losses(s: SparkSession, d: str) -> DataFrame:
    return L.with_losses(test_forecasts(s, d), IM)


def table(s: SparkSession, d: str) -> DataFrame:
    return L.mean_losses(test_forecasts(s, d), IM)


def ratio_table(s: SparkSession, d: str) -> DataFrame:
    return L.ratios(table(s, d), "RVM", ["instrument", "loss"])


# --- combinations --------------------------------------------------------------------------------

register("h01_simple_average", lambda s, d: combine.simple_average(test_forecasts(s, d), ["instrument"]), f"SELECT instrument, {DAY}, round(max(y), 6) AS y, round(avg(y_pred), 6) AS y_pred FROM test GROUP BY instrument, test.day")
_IMSE = "imse AS (SELECT instrument, model, (1 / greatest(e, 1e-12)) / sum(1 / greatest(e, 1e-12)) OVER (PARTITION BY instrument) AS w FROM (SELECT instrument, model, avg((y - y_pred) * (y - y_pred)) AS e FROM fc WHERE split = 'val' GROUP BY 1, 2))"
register("h02_inverse_mse_weights", lambda s, d: combine.inverse_mse_weights(forecasts(s, d).where("split = 'val'"), ["instrument"]), f", {_IMSE} SELECT instrument, model, round(w, 6) AS w FROM imse")


def h3(s: SparkSession, d: str) -> DataFrame:
    """Two models, where the weights have a closed form."""
    val = forecasts(s, d).where("split = 'val' and model in ('RVW', 'RVM')")
    return combine.minimum_variance_weights(val, ["instrument"])


BG = """, e AS (SELECT a.instrument, a.y - a.y_pred AS ea, b.y - b.y_pred AS eb FROM fc a JOIN fc b ON a.instrument = b.instrument AND a.day = b.day AND a.model = 'RVW' AND b.model = 'RVM' WHERE a.split = 'val'),
c AS (SELECT instrument, var_samp(ea) AS va, var_samp(eb) AS vb, covar_samp(ea, eb) AS cab FROM e GROUP BY 1),
w AS (SELECT instrument, least(greatest((vb - cab) / (va + vb - 2 * cab), 0.0), 1.0) AS wa FROM c)"""
register("h03_bates_granger_two", h3, f"""{BG}
SELECT instrument, 'RVW' AS model, round(wa, 5) AS w FROM w UNION ALL SELECT instrument, 'RVM', round(1 - wa, 5) FROM w""", 5)


def h4(s: SparkSession, d: str) -> DataFrame:
    made = combine.combinations(forecasts(s, d), ["instrument"], covariance=False)
    return L.mean_losses(made, IM, "mse")


register("h04_combination_table", h4, f""", {_IMSE}, comb AS (SELECT instrument, day, 'AVG' AS model, max(y) AS y, avg(y_pred) AS y_pred FROM test GROUP BY 1, 2
UNION ALL SELECT t.instrument, t.day, 'IMSE', max(y), sum(w * y_pred) FROM test t JOIN imse i ON i.instrument = t.instrument AND i.model = t.model GROUP BY 1, 2)
SELECT instrument, model, 'mse' AS loss, round(avg((y - y_pred) * (y - y_pred)), 5) AS value FROM comb GROUP BY 1, 2""", 5)
register("h04_combination_forecasts", lambda s, d: combine.combinations(forecasts(s, d), ["instrument"]))
_POOL = "model IN ('RVW', 'RVM')"
register("h04_two_model_combinations", lambda s, d: combine.combinations(forecasts(s, d).where(_POOL), ["instrument"]), f"""{BG}, two AS (SELECT instrument, model, (1 / greatest(e, 1e-12)) / sum(1 / greatest(e, 1e-12)) OVER (PARTITION BY instrument) AS w FROM (SELECT instrument, model, avg((y - y_pred) * (y - y_pred)) AS e FROM fc WHERE split = 'val' AND {_POOL} GROUP BY 1, 2)),
ws AS (SELECT 'AVG' AS name, instrument, model, 0.5 AS w FROM two UNION ALL SELECT 'IMSE', instrument, model, w FROM two UNION ALL SELECT 'BG', instrument, 'RVW', wa FROM w UNION ALL SELECT 'BG', instrument, 'RVM', 1 - wa FROM w)
SELECT t.instrument, {DAY.replace("day AS VARCHAR", "t.day AS VARCHAR")}, name AS model, round(max(y), 5) AS y, round(sum(w * y_pred), 5) AS y_pred FROM test t JOIN ws ON ws.instrument = t.instrument AND ws.model = t.model GROUP BY t.instrument, t.day, name""", 5)

# --- losses --------------------------------------------------------------------------------------

for _id, _c in (("i01_squared_error", "mse"), ("i02_absolute_error", "mae"), ("i03_qlike", "qlike")):
    register(_id, lambda s, d, c=_c: losses(s, d).select("instrument", "model", "day", c), f"SELECT instrument, model, {DAY}, round({_c}, 6) AS {_c} FROM losses")
register("i04_mean_loss_by_name", lambda s, d: L.mean_losses(test_forecasts(s, d), ["model"], "mae"), "SELECT model, 'mae' AS loss, round(avg(mae), 6) AS value FROM losses GROUP BY 1")
register("i05_loss_table", table, "SELECT instrument, model, loss, round(value, 5) AS value FROM losstab", 5)
register("i06_ratio_table", lambda s, d: ratio_table(s, d).drop("value"), "SELECT instrument, model, loss, round(ratio, 6) AS ratio FROM ratiotab")
register("i07_cross_section", lambda s, d: L.across(ratio_table(s, d), ["model", "loss"]).select("model", "loss", "mean_ratio", "median_ratio"), "SELECT model, loss, round(avg(ratio), 6) AS mean_ratio, round(median(ratio), 6) AS median_ratio FROM ratiotab GROUP BY 1, 2")
register("i08_winner_table", lambda s, d: L.winners(ratio_table(s, d), ["instrument", "loss"]).select("instrument", "model", "loss", "ratio", "best"), "SELECT instrument, model, loss, round(ratio, 3) AS ratio, model = arg_min(model, ratio) OVER (PARTITION BY instrument, loss) AS best FROM ratiotab")


def i9(s: SparkSession, d: str) -> DataFrame:
    return L.mean_losses(test_forecasts(s, d, [1, 5, 22]), ["instrument", "horizon", "model"]).where("loss <> 'qlike'")


_H_ALL = "SELECT instrument, horizon, model, l.loss, round(avg(CASE l.loss WHEN 'mse' THEN (y - y_pred) * (y - y_pred) ELSE abs(y - y_pred) END), 5) AS value FROM fc_all, (SELECT unnest(['mse', 'mae']) AS loss) l WHERE split = 'test' GROUP BY 1, 2, 3, 4"
register("i09_horizon_summary", i9, _H_ALL, 5)


def i10(s: SparkSession, d: str) -> DataFrame:
    part = test_forecasts(s, d).where("day between '2000-03-01' and '2000-12-31'")
    return L.ratios(L.mean_losses(part, IM, "mse"), "RVM", ["instrument", "loss"])


register("i10_sub_period", i10, """, p AS (SELECT instrument, model, avg((y - y_pred) * (y - y_pred)) AS v FROM test WHERE day BETWEEN DATE '2000-03-01' AND DATE '2000-12-31' GROUP BY 1, 2)
SELECT instrument, model, 'mse' AS loss, round(v, 5) AS value, round(v / max(CASE WHEN model = 'RVM' THEN v END) OVER (PARTITION BY instrument), 5) AS ratio FROM p""", 5)
register("i11_subset_ratio_table", lambda s, d: L.ratios(table(s, d).where("model in ('RVD', 'RVM')"), "RVM", ["instrument", "loss"]).drop("value"), "SELECT instrument, model, loss, round(ratio, 6) AS ratio FROM ratiotab WHERE model IN ('RVD', 'RVM')")
register("i12_path_decomposition", lambda s, d: L.path_decomposition(ratio_table(s, d), ["instrument", "loss"], "RVD", "RVW", "RVM", ["AVG3"]), """, w AS (SELECT instrument, loss, max(CASE WHEN model = 'RVD' THEN ratio END) AS x, max(CASE WHEN model = 'RVW' THEN ratio END) AS p, max(CASE WHEN model = 'RVM' THEN ratio END) AS f, min(CASE WHEN model = 'AVG3' THEN ratio END) AS nn FROM ratiotab GROUP BY 1, 2)
SELECT instrument, loss, round((x - 1) * 100, 5) AS overfit, round((1 - p) * 100, 5) AS penalty_gain, round((p - f) * 100, 5) AS forest_marginal, round((f - nn) * 100, 5) AS network_marginal, round((1 - nn) * 100, 5) AS total,
  round(CASE WHEN nn < 1 THEN (1 - p) / (1 - nn) END, 5) AS penalty_share FROM w""", 5)
register("i13_ratio_dispersion", lambda s, d: L.across(ratio_table(s, d), ["model", "loss"]).drop("mean_ratio", "median_ratio"), f"SELECT model, loss, {', '.join(f'round(quantile_cont(ratio, CAST({q} AS DOUBLE)), 6) AS {n}' for q, n in ((0.0, 'least'), (0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75'), (1.0, 'most')))} FROM ratiotab GROUP BY 1, 2")
register("i14_best_edge", lambda s, d: L.best_edge(ratio_table(s, d), ["instrument", "loss"], "RVD"), "SELECT instrument, loss, round(greatest((1 - min(CASE WHEN model <> 'RVD' THEN ratio END)) * 100, 0.0), 5) AS edge FROM ratiotab GROUP BY 1, 2", 5)


def i15(s: SparkSession, d: str) -> DataFrame:
    names = {"RVD": "HAR", "RVW": "EN", "RVM": "RF", "AVG3": "NN2^10"}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("model")]
    return table(s, d).withColumn("family", L.family(label)).groupBy("family", "loss").agg(F.avg("value").alias("value"))


register("i15_family_summary", i15, "SELECT CASE model WHEN 'RVD' THEN 'HAR' WHEN 'RVW' THEN 'REG' WHEN 'RVM' THEN 'TREE' ELSE 'NN' END AS family, loss, round(avg(value), 5) AS value FROM losstab GROUP BY 1, 2", 5)

# --- inference -----------------------------------------------------------------------------------

_LRV = """, ser AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY day) AS rn, x - avg(x) OVER (PARTITION BY {keys}) AS e, avg(x) OVER (PARTITION BY {keys}) AS mean, count(*) OVER (PARTITION BY {keys}) AS n FROM ({src})),
lag0 AS (SELECT *, CAST(floor(4 * pow(n / 100.0, CAST(2.0 AS DOUBLE) / 9)) AS INTEGER) AS lags FROM ser),
lrv AS (SELECT {akeys}, max(a.n) AS n, max(a.mean) AS mean, greatest(sum(CASE WHEN a.rn = b.rn THEN 1.0 ELSE 2 * (1 - CAST(a.rn - b.rn AS DOUBLE) / (a.lags + 1)) END * a.e * b.e) / max(a.n), 0.0) AS lrv
  FROM lag0 a JOIN lag0 b ON {on} AND a.rn - b.rn BETWEEN 0 AND a.lags GROUP BY ALL)"""


def _lrv(keys: list[str], src: str) -> str:
    return _LRV.format(keys=", ".join(keys), src=src, akeys=", ".join(f"a.{k}" for k in keys), on=" AND ".join(f"a.{k} = b.{k}" for k in keys))


register("j01_newey_west_lrv", lambda s, d: inference.long_run_variance(inference.placed(losses(s, d), IM), IM, "mae"), f"{_lrv(IM, 'SELECT instrument, model, day, mae AS x FROM losses')} SELECT instrument, model, n, round(mean, 5) AS mean, round(lrv, 5) AS lrv FROM lrv", 5)


def dm(s: SparkSession, d: str, baseline: str | None = None, loss: str = "mae") -> DataFrame:
    return inference.pairwise_tests(losses(s, d), ["instrument"], loss, baseline)


_PAIR = "SELECT x.instrument, x.model AS a, y.model AS b, x.day, x.mae - y.mae AS x FROM losses x JOIN losses y ON x.instrument = y.instrument AND x.day = y.day AND x.model <> y.model"
_DM = "round(CASE WHEN lrv > 0 THEN mean / sqrt(lrv / n) END * sqrt((n + 1 - 2 + 0.0) / n), 5) AS dm"
register("j02_diebold_mariano", lambda s, d: dm(s, d, "RVM").select("instrument", "a", "b", "n", "dm"), f"{_lrv(['instrument', 'a', 'b'], _PAIR)} SELECT instrument, a, b, n, {_DM} FROM lrv WHERE b = 'RVM'", 5)
# Student's distribution with whole degrees of freedom is a finite sum of powers of a cosine
_STUDENT = f"""{_lrv(['instrument', 'a', 'b'], _PAIR)}, st AS (SELECT instrument, a, b, n - 1 AS df, {_DM.replace('round(', '').replace(', 5) AS dm', '')} AS dm FROM lrv WHERE b = 'RVM'),
an AS (SELECT *, atan(dm / sqrt(df)) AS th FROM st),
sh AS (SELECT *, CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos(th), 2 * k + 1))), 0.0))
  ELSE sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(th), 2 * k))) END AS share FROM an)"""
register("j03_small_sample_p_values", lambda s, d: dm(s, d, "RVM").select("instrument", "a", "b", "dm", "p_value"), f"{_STUDENT} SELECT instrument, a, b, round(dm, 5) AS dm, round(0.5 * (1 + share), 5) AS p_value FROM sh", 5)
register("j04_pairwise_matrix", lambda s, d: dm(s, d).select("instrument", "a", "b", "n", "dm"), f"{_lrv(['instrument', 'a', 'b'], _PAIR)} SELECT instrument, a, b, n, {_DM} FROM lrv", 5)


def j5(s: SparkSession, d: str) -> DataFrame:
    found = dm(s, d, "RVM").select("instrument", F.col("a").alias("model"), "dm", "p_value")
    base = found.select("instrument").distinct().select("instrument", F.lit("RVM").alias("model"), F.lit(None).cast("double").alias("dm"), F.lit(None).cast("double").alias("p_value"))
    return found.unionByName(base)


register("j05_baseline_table", lambda s, d: j5(s, d).drop("p_value"), f"{_lrv(['instrument', 'a', 'b'], _PAIR)} SELECT instrument, a AS model, {_DM} FROM lrv WHERE b = 'RVM' UNION ALL SELECT DISTINCT instrument, 'RVM', CAST(NULL AS DOUBLE) FROM lrv", 5)


def pseudo_p(s: SparkSession, d: str) -> DataFrame:
    """One p-value-like share per instrument, model and month: test targets near zero are small."""
    rows = losses(s, d).groupBy("instrument", "model", F.month("day").alias("month")).agg(F.avg("mae").alias("v"))
    p = F.col("v") / F.max("v").over(Window.partitionBy("instrument"))
    return rows.select("instrument", F.concat_ws("-", "model", "month").alias("test"), F.when(F.col("month") == 12, None).otherwise(p * p * p * p).alias("p"))


_P = """, pv AS (SELECT instrument, concat_ws('-', model, m) AS test, CASE WHEN m = 12 THEN NULL ELSE pow(v / max(v) OVER (PARTITION BY instrument), 4) END AS p FROM (SELECT instrument, model, month(day) AS m, avg(mae) AS v FROM losses GROUP BY 1, 2, 3)),
rk AS (SELECT *, count(p) OVER (PARTITION BY instrument) AS m, row_number() OVER (PARTITION BY instrument ORDER BY p NULLS LAST, test) AS i FROM pv),
mt AS (SELECT instrument, test, p, m, coalesce(p <= 0.05, false) AS naive, coalesce(p <= 0.05 / m, false) AS bonferroni,
  p IS NOT NULL AND min(CASE WHEN p <= 0.05 / (m - i + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY i) = 1 AS holm,
  p IS NOT NULL AND coalesce(i <= max(CASE WHEN p <= 0.05 * i / m THEN i END) OVER (PARTITION BY instrument), false) AS bh FROM rk)"""
for _id, _c in (("j06_bonferroni", "bonferroni"), ("j07_holm", "holm"), ("j08_benjamini_hochberg", "bh")):
    register(_id, lambda s, d, c=_c: inference.multiple_testing(pseudo_p(s, d), ["instrument"]).select("instrument", "test", c), f"{_P} SELECT instrument, test, {_c} FROM mt")
register("j09_rejection_summary", lambda s, d: inference.rejections(inference.multiple_testing(pseudo_p(s, d), ["instrument"]), ["instrument"]), f"{_P} SELECT instrument, {', '.join(f'CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS n_{c}' for c in ('naive', 'bonferroni', 'holm', 'bh'))}, max(m) AS m, round(0.05 / max(m), 6) AS bonferroni_threshold FROM mt GROUP BY 1")

_BOOT = f""", src AS (SELECT instrument, model, row_number() OVER (PARTITION BY instrument, model ORDER BY day) AS rn, {{values}} FROM {{source}}),
pre AS (SELECT instrument, model, rn, {{sums}} FROM src UNION ALL SELECT DISTINCT instrument, model, 0, {{zeros}} FROM src),
sz AS (SELECT instrument, model, count(*) AS n, greatest(1, CAST(round(pow(count(*), CAST(1.0 AS DOUBLE) / 3)) AS BIGINT)) AS len FROM src GROUP BY 1, 2),
pl AS (SELECT sz.*, d.range AS draw, b.range AS block FROM sz, range({{draws}}) d, range(2000) b WHERE b.range < ceil(n / CAST(len AS DOUBLE))),
lc AS (SELECT *, (CAST(1103515245 AS BIGINT) * ((CAST(1103515245 AS BIGINT) * (draw * 1009 + block + 42) + 12345) % 2147483648) + 12345) % 2147483648 AS mixed FROM pl),
st AS (SELECT *, CAST(mixed // 65536 AS BIGINT) % (n - len + 1) AS lo, CAST(mixed // 65536 AS BIGINT) % (n - len + 1) + least(len, n - block * len) AS hi FROM lc),
bm AS (SELECT st.instrument, st.model, st.draw, {{means}} FROM st JOIN pre a ON a.instrument = st.instrument AND a.model = st.model AND a.rn = st.lo JOIN pre b ON b.instrument = st.instrument AND b.model = st.model AND b.rn = st.hi GROUP BY 1, 2, 3)"""


def _boot(values: dict[str, str], source: str = "losses", draws: int = DRAWS) -> str:
    run = "OVER (PARTITION BY instrument, model ORDER BY rn)"
    return _BOOT.format(
        values=", ".join(f"{e} AS {n}" for n, e in values.items()), source=source, draws=draws, sums=", ".join(f"sum({n}) {run} AS s_{n}" for n in values),
        zeros=", ".join("0.0" for _ in values), means=", ".join(f"sum(b.s_{n} - a.s_{n}) / max(n) AS {n}_mean" for n in values),
    )


_Q = "round(quantile_cont({0}, CAST(0.025 AS DOUBLE)), 5) AS lower, round(quantile_cont({0}, CAST(0.975 AS DOUBLE)), 5) AS upper, round(stddev_samp({0}), 5) AS se"
register("j10_block_bootstrap_means", lambda s, d: inference.bootstrap_means(inference.placed(losses(s, d), IM), IM, ["mae"], DRAWS), f"{_boot({'mae': 'mae'})} SELECT instrument, model, CAST(draw AS INTEGER) AS draw, round(mae_mean, 5) AS mae_mean FROM bm", 5)
register("j11_loss_interval", lambda s, d: inference.loss_interval(inference.placed(losses(s, d), IM), IM, "mae", DRAWS), f"{_boot({'mae': 'mae'})} SELECT instrument, model, {_Q.format('mae_mean')} FROM bm GROUP BY 1, 2", 5)


def with_baseline(s: SparkSession, d: str) -> DataFrame:
    rows = losses(s, d)
    base = rows.where("model = 'RVM'").select("instrument", "day", F.col("mae").alias("base"))
    return inference.placed(rows.join(base, ["instrument", "day"]), IM)


_BASE = "(SELECT z.mae FROM losses z WHERE z.instrument = losses.instrument AND z.day = losses.day AND z.model = 'RVM')"
register("j12_difference_interval", lambda s, d: inference.difference_interval(with_baseline(s, d), IM, "mae", "base", DRAWS), f"{_boot({'diff': f'mae - {_BASE}'})} SELECT instrument, model, {_Q.format('diff_mean')} FROM bm GROUP BY 1, 2", 5)
register("j13_ratio_interval", lambda s, d: inference.ratio_interval(with_baseline(s, d), IM, "mae", "base", DRAWS), f"{_boot({'mae': 'mae', 'base': _BASE})} SELECT instrument, model, {_Q.format('(mae_mean / base_mean)')} FROM bm WHERE base_mean > 0 GROUP BY 1, 2", 5)


#: The rules stand for the models of the path: wide linear, penalised, forest, and a pool of networks.
STEPS = {"wide": "RVD", "penalised": "RVW", "forest": "RVD"}
POOL = ["RVW", "AVG3"]


def j14(s: SparkSession, d: str) -> DataFrame:
    """Intervals of the path legs, the best network chosen by mean loss on common days."""
    legs = inference.path_legs(losses(s, d), ["instrument"], "mae", "RVM", STEPS, POOL)
    return inference.ratio_interval(inference.placed(legs, ["instrument", "best", "leg"]), ["instrument", "best", "leg"], "top", "bottom", DRAWS)


_LEGS = ", ".join(f"{{'leg': '{leg}', 'top': {top}, 'bottom': {bottom}}}" for leg, top, bottom in (("wide", "w", "b"), ("penalised", "p", "b"), ("forest", "f", "p"), ("network", "nn", "f"), ("total", "nn", "b")))
_PATH = f""", pw AS (SELECT instrument, day, {", ".join(f"max(CASE WHEN model = '{m}' THEN mae END) AS {c}" for c, m in (("b", "RVM"), ("w", STEPS["wide"]), ("p", STEPS["penalised"]), ("f", STEPS["forest"])))}, {", ".join(f"max(CASE WHEN model = '{m}' THEN mae END) AS n{i}" for i, m in enumerate(POOL))} FROM losses GROUP BY 1, 2),
pb AS (SELECT instrument, CASE WHEN avg(n0) <= avg(n1) THEN '{POOL[0]}' ELSE '{POOL[1]}' END AS best FROM pw GROUP BY 1),
pq AS (SELECT pw.*, best, CASE WHEN best = '{POOL[0]}' THEN n0 ELSE n1 END AS nn FROM pw JOIN pb ON pb.instrument = pw.instrument),
pg AS (SELECT instrument, best || '/' || l.leg AS model, day, l.top AS top, l.bottom AS bottom FROM (SELECT *, unnest([{_LEGS}]) AS l FROM pq))"""
register("j14_path_intervals", j14, f"{_PATH}{_boot({'top': 'top', 'bottom': 'bottom'}, 'pg')} SELECT instrument, split_part(model, '/', 1) AS best, split_part(model, '/', 2) AS leg, {_Q.format('(top_mean / bottom_mean)')} FROM bm WHERE bottom_mean > 0 GROUP BY 1, model", 5)
_DEV = "mae - (SELECT avg(z.mae) FROM losses z WHERE z.instrument = losses.instrument AND z.day = losses.day)"
register("j15_first_round_tmax", lambda s, d: inference.first_round_tmax(losses(s, d), ["instrument"], "mae", DRAWS).drop("worst"), f"{_boot({'dv': _DEV})}, sp AS (SELECT instrument, model, stddev_samp(dv_mean) AS sd FROM bm GROUP BY 1, 2), ce AS (SELECT instrument, model, avg(dv) AS dv FROM src GROUP BY 1, 2) SELECT ce.instrument, round(max(dv / CASE WHEN sd > 0 THEN sd ELSE 1e-12 END), 4) AS t_max FROM ce JOIN sp ON sp.instrument = ce.instrument AND sp.model = ce.model GROUP BY 1", 4)


def _elimination(models: list[str]) -> str:
    """Each round on the surviving models (al), its statistic and worst model (ro); then, for each
    level, the round whose p-value is the first above it."""
    out, k = ["bx AS (SELECT instrument, model, draw, x_mean AS x FROM bm), ax AS (SELECT instrument, model, avg(mae) AS m FROM losses GROUP BY 1, 2), al1 AS (SELECT * FROM ax)"], len(models)
    for r in range(1, k):
        before = f"ro{r - 1}.running" if r > 1 else "0.0"
        join = f"JOIN ro{r - 1} ON ro{r - 1}.instrument = w.instrument" if r > 1 else ""
        out.append(f"""ce{r} AS (SELECT instrument, model, m, m - avg(m) OVER (PARTITION BY instrument) AS d FROM al{r}),
de{r} AS (SELECT b.instrument, b.model, b.draw, x - avg(x) OVER (PARTITION BY b.instrument, b.draw) AS v FROM bx b JOIN al{r} a ON a.instrument = b.instrument AND a.model = b.model),
tt{r} AS (SELECT c.instrument, c.model, d, s.sd, d / s.sd AS t FROM ce{r} c JOIN (SELECT instrument, model, CASE WHEN stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1e-12 END AS sd FROM de{r} GROUP BY 1, 2) s ON s.instrument = c.instrument AND s.model = c.model),
wo{r} AS (SELECT instrument, max(t) AS t_max, arg_max(model, t) AS worst FROM tt{r} GROUP BY 1),
no{r} AS (SELECT e.instrument, e.draw, max((e.v - t.d) / t.sd) AS most FROM de{r} e JOIN tt{r} t ON t.instrument = e.instrument AND t.model = e.model GROUP BY 1, 2),
pv{r} AS (SELECT n.instrument, avg(CASE WHEN most >= t_max THEN 1.0 ELSE 0.0 END) AS p FROM no{r} n JOIN wo{r} w ON w.instrument = n.instrument GROUP BY 1),
ro{r} AS (SELECT w.instrument, w.worst, greatest(p, {before}) AS running FROM wo{r} w JOIN pv{r} ON pv{r}.instrument = w.instrument {join}),
al{r + 1} AS (SELECT a.* FROM al{r} a JOIN ro{r} ON ro{r}.instrument = a.instrument AND ro{r}.worst <> a.model)""")
    rounds = " UNION ALL ".join(f"SELECT instrument, worst AS model, {r} AS round, running FROM ro{r}" for r in range(1, k))
    out.append(f"""el AS ({rounds} UNION ALL SELECT instrument, model, {k}, 1.0 FROM al{k}),
stp AS (SELECT a.alpha, el.instrument, min(CASE WHEN running > a.alpha OR round = {k} THEN round END) AS stop FROM el, (SELECT unnest([0.25, 0.1, 0.05]) AS alpha) a GROUP BY 1, 2),
ms AS (SELECT e.instrument, CAST(s.alpha AS DOUBLE) AS alpha, e.model, CASE WHEN e.round < s.stop THEN e.running ELSE f.running END AS p_value, e.round >= s.stop AS included FROM el e JOIN stp s ON s.instrument = e.instrument JOIN el f ON f.instrument = e.instrument AND f.round = s.stop)""")
    return ", " + ",\n".join(out)


_SET = _boot({"x": "mae"}, draws=SET_DRAWS) + _elimination(["RVD", "RVW", "RVM", "AVG3"])
_set = lambda s, d: inference.confidence_set(losses(s, d), ["instrument"], "mae", SET_DRAWS)
register("j15_model_confidence_set", _set, f"{_SET} SELECT instrument, alpha, model, round(p_value, 4) AS p_value, included FROM ms", 4)
register("j16_inclusion_counts", lambda s, d: _set(s, d).groupBy("alpha", "model").agg(F.sum(F.col("included").cast("int")).alias("n_included")), f"{_SET} SELECT alpha, model, CAST(sum(CAST(included AS INTEGER)) AS BIGINT) AS n_included FROM ms GROUP BY 1, 2")

_MZ = """, fit AS (SELECT instrument, model, count(*) AS n, regr_intercept(y, y_pred) AS a, regr_slope(y, y_pred) AS b, regr_r2(y, y_pred) AS r2, sum(y_pred) AS sp, sum(y_pred * y_pred) AS spp, avg(y) AS my, avg(y_pred) AS mp,
  stddev_pop(y) AS sy, stddev_pop(y_pred) AS sdp, corr(y, y_pred) AS rho, avg((y - y_pred) * (y - y_pred)) AS mse FROM test GROUP BY 1, 2),
sc AS (SELECT t.instrument, t.model, row_number() OVER (PARTITION BY t.instrument, t.model ORDER BY day) AS rn, f.n, y - a - b * y_pred AS g0, (y - a - b * y_pred) * y_pred AS g1, CAST(floor(4 * pow(f.n / 100.0, CAST(2.0 AS DOUBLE) / 9)) AS INTEGER) AS lags FROM test t JOIN fit f ON f.instrument = t.instrument AND f.model = t.model),
ss AS (SELECT p.instrument, p.model, sum(w * CASE WHEN k = 0 THEN 1 ELSE 2 END * g00) AS s00, sum(w * CASE WHEN k = 0 THEN x1 ELSE x1 + x2 END) AS s01, sum(w * CASE WHEN k = 0 THEN 1 ELSE 2 END * g11) AS s11
  FROM (SELECT u.instrument, u.model, u.rn - v.rn AS k, CASE WHEN u.rn = v.rn THEN 1.0 ELSE 1 - CAST(u.rn - v.rn AS DOUBLE) / (u.lags + 1) END AS w, u.g0 * v.g0 AS g00, u.g0 * v.g1 AS x1, v.g0 * u.g1 AS x2, u.g1 * v.g1 AS g11
    FROM sc u JOIN sc v ON u.instrument = v.instrument AND u.model = v.model AND u.rn - v.rn BETWEEN 0 AND u.lags) p GROUP BY 1, 2),
mz AS (SELECT f.*, (s11 * u0 * u0 - 2 * s01 * u0 * u1 + s00 * u1 * u1) / (s00 * s11 - s01 * s01) AS wald FROM (SELECT *, n * a + sp * (b - 1) AS u0, sp * a + spp * (b - 1) AS u1 FROM fit) f JOIN ss ON ss.instrument = f.instrument AND ss.model = f.model)"""
_mz = lambda s, d: inference.mincer_zarnowitz(test_forecasts(s, d), IM)
register("j17_mincer_zarnowitz", lambda s, d: _mz(s, d).select(*IM, "n", "a", "b", "r2"), f"{_MZ} SELECT instrument, model, n, {rounded('a, b, r2', 5)} FROM mz", 5)
register("j18_hac_wald", lambda s, d: _mz(s, d).select(*IM, "wald"), f"{_MZ} SELECT instrument, model, round(wald, 3) AS wald FROM mz", 3)
register("j19_joint_test_p_value", lambda s, d: _mz(s, d).select(*IM, "p_value"), f"{_MZ} SELECT instrument, model, round(exp(-wald / 2), 5) AS p_value FROM mz", 5)
_THEIL = "round((my - mp) * (my - mp) / mse, 5) AS bias, round(pow(sdp - rho * sy, 2) / mse, 5) AS regression, round((1 - rho * rho) * sy * sy / mse, 5) AS disturbance"
register("j20_theil_decomposition", lambda s, d: _mz(s, d).select(*IM, "bias", "regression", "disturbance"), f"{_MZ} SELECT instrument, model, {_THEIL} FROM mz", 5)
register("j21_efficiency_table", _mz, f"{_MZ} SELECT instrument, model, n, {rounded('a, b, r2', 4)}, round(wald, 4) AS wald, round(exp(-wald / 2), 4) AS p_value, {_THEIL.replace(', 5)', ', 4)')} FROM mz", 4)

# --- conditional evaluation ----------------------------------------------------------------------

_DEC = """, ed AS (SELECT instrument, quantile_cont(y, [CAST(0.1 AS DOUBLE), 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM (SELECT DISTINCT instrument, day, y FROM test) GROUP BY 1),
dc AS (SELECT t.*, len(list_filter(edges, lambda e: e <= y)) + 1 AS decile FROM test t JOIN ed ON ed.instrument = t.instrument),
dl AS (SELECT instrument, CAST(decile AS INTEGER) AS decile, model, avg((y - y_pred) * (y - y_pred)) AS value, count(*) AS n FROM dc GROUP BY 1, 2, 3)"""
_dec = lambda s, d: conditional.decile_losses(test_forecasts(s, d), ["instrument"]).where("loss = 'mse'").drop("loss")
register("k01_decile_losses", _dec, f"{_DEC} SELECT instrument, decile, model, round(value, 4) AS value, n FROM dl", 4)
register("k02_decile_ratios", lambda s, d: L.ratios(_dec(s, d), "RVM", ["instrument", "decile"]).select("instrument", "decile", "model", "ratio"), f"{_DEC} SELECT instrument, decile, model, round(value / max(CASE WHEN model = 'RVM' THEN value END) OVER (PARTITION BY instrument, decile), 4) AS ratio FROM dl", 4)
register("k03_top_decile", lambda s, d: _dec(s, d).where("decile = 10").drop("decile"), f"{_DEC} SELECT instrument, model, round(value, 4) AS value, n FROM dl WHERE decile = 10", 4)
_pooled = lambda s, d: conditional.decile_losses(test_forecasts(s, d), [], by=("instrument", "day"), large=True)
register("k01_pooled_deciles", lambda s, d: _pooled(s, d).where("loss = 'mse'").drop("loss"), f""", pe AS (SELECT quantile_cont(y, [{", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(1, 10))}]) AS edges FROM (SELECT DISTINCT instrument, day, y FROM test)),
pd AS (SELECT t.*, len(list_filter(edges, lambda e: e <= y)) + 1 AS decile FROM test t, pe)
SELECT CAST(decile AS INTEGER) AS decile, model, round(avg((y - y_pred) * (y - y_pred)), 4) AS value, count(*) AS n FROM pd GROUP BY 1, 2""", 4)
register("k04_regimes", lambda s, d: conditional.fit_regimes(daily(s, d)))
register("k04_regime_parameters", lambda s, d: conditional.regime_parameters(conditional.regime_fits(daily(s, d))), digits=3)


def labels(s: SparkSession, d: str) -> DataFrame:
    """High where the week's lagged average is above the month's."""
    return split_features(s, d, [1]).select("instrument", "day", (F.col("rvw") > F.col("rvm")).cast("int").alias("regime"))


_REG = ", lb AS (SELECT instrument, day, CAST(rvw > rvm AS INTEGER) AS regime FROM splitted WHERE horizon = 1), rg AS (SELECT t.instrument, regime, model, avg((y - y_pred) * (y - y_pred)) AS value FROM test t JOIN lb ON lb.instrument = t.instrument AND lb.day = t.day GROUP BY 1, 2, 3)"
_regime = lambda s, d: conditional.regime_losses(test_forecasts(s, d), labels(s, d), ["instrument"]).where("loss = 'mse'")
register("k05_regime_losses", lambda s, d: _regime(s, d).drop("loss"), f"{_REG} SELECT instrument, regime, model, round(value, 4) AS value FROM rg", 4)
register("k06_regime_ratios_pooled", lambda s, d: conditional.regime_ratios(_regime(s, d), "RVM", ["instrument"]).groupBy("regime", "model").agg(F.avg("ratio").alias("ratio")), f"{_REG} SELECT regime, model, round(avg(ratio), 4) AS ratio FROM (SELECT *, value / max(CASE WHEN model = 'RVM' THEN value END) OVER (PARTITION BY instrument, regime) AS ratio FROM rg) GROUP BY 1, 2", 4)

# --- Value-at-Risk -------------------------------------------------------------------------------


def var_rows(s: SparkSession, d: str) -> DataFrame:
    """Returns, realised variance and two forecasts; calibration days are train and val."""
    panel = daily(s, d).select("instrument", "day", "ret", "rv")
    fc = forecasts(s, d).where("model in ('RVW', 'RVM')").select("instrument", "day", "model", F.col("y_pred").alias("rv_hat"), (F.col("split") != "test").alias("seed"))
    return fc.join(panel, ["instrument", "day"])


_VAR = """, vr AS (SELECT f.instrument, f.day, f.model, f.y_pred AS rv_hat, f.split <> 'test' AS seed, d.ret, d.ret / sqrt(greatest(d.rv, 1e-12)) AS z FROM fc f JOIN daily d ON d.instrument = f.instrument AND d.day = f.day WHERE f.model IN ('RVW', 'RVM')),
fq AS (SELECT instrument, model, quantile_cont(z, CAST(0.05 AS DOUBLE)) AS q FROM vr WHERE seed GROUP BY 1, 2),
fj AS (SELECT v.instrument, v.model, v.day, ret, q * sqrt(greatest(rv_hat, 1e-12)) AS var FROM vr v JOIN fq ON fq.instrument = v.instrument AND fq.model = v.model WHERE NOT seed),
eq AS (SELECT *, quantile_cont(z, CAST(0.05 AS DOUBLE)) OVER (PARTITION BY instrument, model ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM vr),
ej AS (SELECT instrument, model, day, ret, q * sqrt(greatest(rv_hat, 1e-12)) AS var FROM eq WHERE NOT seed),
jd AS (SELECT *, CAST(ret <= var AS INTEGER) AS hit, (CAST(0.05 AS DOUBLE) - CASE WHEN ret <= var THEN 1.0 ELSE 0.0 END) * (ret - var) AS tick FROM {src}),
lg AS (SELECT *, lag(hit) OVER (PARTITION BY instrument, model ORDER BY day) AS b FROM jd),
ct AS (SELECT instrument, model, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, avg(tick) AS mean_tick, {moves} FROM lg GROUP BY 1, 2),
pr AS (SELECT *, least(greatest(hits / CAST(n AS DOUBLE), 1e-12), 1 - 1e-12) AS pi, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS p0, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS p1, (n01 + n11) / (n00 + n01 + n10 + n11) AS p FROM ct),
lk AS (SELECT *, greatest(-2 * ((n - hits) * ln(0.95) + hits * ln(0.05) - (n - hits) * ln(1 - pi) - hits * ln(pi)), 0.0) AS lr_uc,
  greatest(-2 * ({one} - ({two})), 0.0) AS lr_ind FROM pr)"""


def _var(src: str) -> str:
    ll = lambda n, p: f"(CASE WHEN {p} > 0 AND {p} < 1 THEN {n} * ln(nullif({p}, 0)) ELSE 0.0 END)"
    moves = ", ".join(f"CAST(sum(CASE WHEN b = {i} AND hit = {j} THEN 1 ELSE 0 END) AS DOUBLE) AS n{i}{j}" for i in (0, 1) for j in (0, 1))
    one = f"{ll('(n00 + n10)', '(1 - p)')} + {ll('(n01 + n11)', 'p')}"
    two = f"{ll('n00', '(1 - p0)')} + {ll('n01', 'p0')} + {ll('n10', '(1 - p1)')} + {ll('n11', 'p1')}"
    return _VAR.format(src=src, moves=moves, one=f"({one})", two=two)


fixed = lambda s, d, a=0.05: risk.fixed_quantile(var_rows(s, d), IM, a)
expanding = lambda s, d, a=0.05, m=1: risk.expanding_quantile(var_rows(s, d), IM, a, every=m)
register("l01_filtered_simulation", lambda s, d: fixed(s, d).select(*IM, "day", "var", "hit"), f"{_var('fj')} SELECT instrument, model, {DAY}, round(var, 5) AS var, hit FROM jd", 5)
register("l02_expanding_quantile", lambda s, d: expanding(s, d).select(*IM, "day", "var", "hit"), f"{_var('ej')} SELECT instrument, model, {DAY}, round(var, 5) AS var, hit FROM jd", 5)
register("l02_expanding_quantile_monthly", lambda s, d: expanding(s, d, 0.05, 22).select(*IM, "day", "var"), f"""{_var('ej')}, em AS (SELECT *, row_number() OVER (PARTITION BY instrument, model ORDER BY day) - 1 AS k FROM eq WHERE NOT seed)
SELECT a.instrument, a.model, CAST(a.day AS VARCHAR) AS day, round(b.q * sqrt(greatest(a.rv_hat, 1e-12)), 5) AS var FROM em a JOIN em b ON a.instrument = b.instrument AND a.model = b.model AND b.k = a.k - a.k % 22""", 5)
register("l03_pinball_loss", lambda s, d: fixed(s, d).select(*IM, "day", "tick"), f"{_var('fj')} SELECT instrument, model, {DAY}, round(tick, 5) AS tick FROM jd", 5)
_cover = lambda s, d: risk.coverage(fixed(s, d), IM)
register("l04_unconditional_coverage", lambda s, d: _cover(s, d).select(*IM, "n", "hits", "lr_uc"), f"{_var('fj')} SELECT instrument, model, n, hits, round(lr_uc, 5) AS lr_uc FROM lk", 5)
register("l05_conditional_coverage", lambda s, d: _cover(s, d).select(*IM, "lr_ind", "lr_cc", "p_cc"), f"{_var('fj')} SELECT instrument, model, round(lr_ind, 5) AS lr_ind, round(lr_uc + lr_ind, 5) AS lr_cc, round(exp(-(lr_uc + lr_ind) / 2), 5) AS p_cc FROM lk", 5)


def l6(s: SparkSession, d: str) -> DataFrame:
    return risk.coverage(fixed(s, d, 0.05).unionByName(fixed(s, d, 0.01)), IM).select(*IM, "alpha", "n", "hits", "expected", "rate")


register("l06_var_table", l6, f"{_var('fj')}, f1 AS (SELECT instrument, model, quantile_cont(z, CAST(0.01 AS DOUBLE)) AS q FROM vr WHERE seed GROUP BY 1, 2) SELECT instrument, model, CAST(0.05 AS DOUBLE) AS alpha, n, hits, round(n * 0.05, 5) AS expected, round(hits / CAST(n AS DOUBLE), 5) AS rate FROM lk UNION ALL SELECT v.instrument, v.model, 0.01, count(*), CAST(sum(CAST(ret <= q * sqrt(greatest(rv_hat, 1e-12)) AS INTEGER)) AS BIGINT), round(count(*) * 0.01, 5), round(sum(CAST(ret <= q * sqrt(greatest(rv_hat, 1e-12)) AS INTEGER)) / CAST(count(*) AS DOUBLE), 5) FROM vr v JOIN f1 ON f1.instrument = v.instrument AND f1.model = v.model WHERE NOT seed GROUP BY 1, 2", 5)


def l7(s: SparkSession, d: str) -> DataFrame:
    rows = fixed(s, d)
    a = rows.where("model = 'RVW'").select("instrument", "day", F.col("tick").alias("loss_a"))
    b = rows.where("model = 'RVM'").select("instrument", "day", F.col("tick").alias("loss_b"))
    return inference.diebold_mariano(inference.placed(a.join(b, ["instrument", "day"]), ["instrument"]), ["instrument"]).select("instrument", "n", "dm")


register("l07_tick_loss_test", l7, f"{_var('fj')}{_lrv(['instrument'], 'SELECT a.instrument, a.day, a.tick - b.tick AS x FROM jd a JOIN jd b ON a.instrument = b.instrument AND a.day = b.day AND a.model = ' + chr(39) + 'RVW' + chr(39) + ' AND b.model = ' + chr(39) + 'RVM' + chr(39))} SELECT instrument, n, {_DM} FROM lrv", 5)
register("l08_expanding_coverage", lambda s, d: risk.coverage(expanding(s, d), IM).select(*IM, "n", "hits", "mean_tick", "lr_uc", "lr_ind"), f"{_var('ej')} SELECT instrument, model, n, hits, round(mean_tick, 5) AS mean_tick, round(lr_uc, 5) AS lr_uc, round(lr_ind, 5) AS lr_ind FROM lk", 5)

# --- dependence ----------------------------------------------------------------------------------


#: Lags of the in-sample style, and of the comparison of forecasts with realised values.
LAGS, SHORT_LAGS = 250, 60


def acf_series(s: SparkSession, d: str) -> DataFrame:
    """The realised values of the test days as a series of their own beside each model's forecasts."""
    rows = test_forecasts(s, d)
    real = rows.where("model = 'RVM'").select("instrument", "day", F.lit("realised").alias("model"), F.col("y").alias("x"))
    return inference.placed(real.unionByName(rows.select("instrument", "day", "model", F.col("y_pred").alias("x"))), IM)


def _acf(lags: int, short: str) -> str:
    return f""", ar AS (SELECT instrument, 'realised' AS model, day, y AS x FROM test WHERE model = 'RVM' UNION ALL SELECT instrument, model, day, y_pred FROM test),
er AS (SELECT instrument, model, row_number() OVER (PARTITION BY instrument, model ORDER BY day) AS rn, x - avg(x) OVER w AS e, var_pop(x) OVER w AS v, count(*) OVER w AS n FROM ar WINDOW w AS (PARTITION BY instrument, model)),
ks AS (SELECT instrument, model, k.range AS k, n, v FROM (SELECT instrument, model, max(n) AS n, max(v) AS v FROM er GROUP BY 1, 2), range({lags + 1}) k),
sm AS (SELECT a.instrument, a.model, a.rn - b.rn AS k, sum(a.e * b.e) AS s FROM er a JOIN er b ON a.instrument = b.instrument AND a.model = b.model AND a.rn - b.rn BETWEEN 0 AND {lags} GROUP BY 1, 2, 3)
SELECT ks.instrument, ks.model, CAST(ks.k AS INTEGER) AS k, round(CASE WHEN v <= 0 THEN 0.0 WHEN {short.format("n", "ks.k")} THEN 0.0 WHEN ks.k = 0 THEN 1.0 ELSE s / ((n - ks.k) * v) END, 5) + 0 AS acf, round(1.96 / sqrt(n), 5) AS band
FROM ks LEFT JOIN sm ON sm.instrument = ks.instrument AND sm.model = ks.model AND sm.k = ks.k"""


register("m04_autocorrelation", lambda s, d: inference.autocorrelation(acf_series(s, d), IM, "x", LAGS), _acf(LAGS, "{1} > 0 AND {0} - {1} < 5"), 5)
register("m04_forecast_memory", lambda s, d: inference.autocorrelation(acf_series(s, d), IM, "x", SHORT_LAGS, "series"), _acf(SHORT_LAGS, f"{{0}} < {SHORT_LAGS + 5}"), 5)
register("m05_error_correlation", lambda s, d: inference.error_correlation(test_forecasts(s, d)), "SELECT a.model AS a, b.model AS b, round(corr(a.y - a.y_pred, b.y - b.y_pred), 5) AS corr FROM test a JOIN test b ON a.instrument = b.instrument AND a.day = b.day GROUP BY 1, 2", 5)
