"""Linear forecasters fitted from cross-product aggregates.

One pass sums the products of all regressors per group; what is solved afterwards is a small matrix
per group, whatever the number of rows. Groups are solved in parallel by ``mapInPandas`` over rows of
matrices, never over data rows; penalty grids are dealt out, ``GRID_BATCH`` points to a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rolling import fixed_models, rolling_models  # noqa: F401
from tidemark.operators.spread import dealt
from tidemark.storage import cut

#: Grid points that a task solves.
GRID_BATCH = 25
HAR = ["rvd", "rvw", "rvm"]
MODELS = {
    "HAR": HAR,
    "LevHAR": [*HAR, "rn_d", "rn_w", "rn_m"],
    "SHAR": ["rvd_pos", "rvd_neg", "rvw", "rvm"],
    "HARQ": [*HAR, "rq_x_rv"],
}
#: All lag models of a panel run.
FAMILY = MODELS | {"LogHAR": HAR}
WIDE = [*HAR, "iv", "m1w", "vix_lag", "epu_lag", "hsi_lag", "ads_lag", "us3m_change", "event_lag", "dvol"]


def moments(rows: DataFrame, keys: list[str], x: list[str], y: str = "y") -> DataFrame:
    """Per group, in one pass: ``n``, ``mean`` (of x then y) and ``cross``, the centred products, flattened."""
    names = [*x, y]
    n, size = F.count(F.lit(1)), range(len(names))
    pairs = {(i, j): F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in size for j in size if i <= j}
    sums = rows.groupBy(*keys).agg(n.alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean"), *pairs.values())
    return sums.select(*keys, "n", "mean", F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") * F.col("n") for i in size for j in size]).alias("cross"))


def _solve(cross: np.ndarray, cut: float = 1e-10) -> np.ndarray:
    """Minimum-norm least squares on the correlation scale."""
    a, b = cross[:-1, :-1], cross[:-1, -1]
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1
    values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
    keep = values > cut * values.max()
    return (vectors[:, keep] / values[keep]) @ (vectors[:, keep].T @ (b / scale)) / scale


def _fit_groups(sums: DataFrame, keys: list[str], x: list[str], solve) -> DataFrame:
    """(keys, intercept, beta array, sigma2, n): ``solve(cross, n)`` gives the slopes."""
    p = len(x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {k: pdf[k].to_list() for k in keys} | {"intercept": [], "beta": [], "sigma2": [], "n": pdf["n"].to_list()}
        for mean, cross, n in zip(pdf["mean"], pdf["cross"], pdf["n"], strict=True):
            m, c = np.array(mean), np.array(cross).reshape(p + 1, p + 1)
            beta = solve(c, n)
            left = c[-1, -1] - 2 * beta @ c[:-1, -1] + beta @ c[:-1, :-1] @ beta
            out["beta"].append(beta.tolist())
            out["intercept"].append(float(m[-1] - beta @ m[:-1]))
            out["sigma2"].append(float(max(left, 0) / max(n - p - 1, 1)))
        return pd.DataFrame(out)

    kinds = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, intercept double, beta array<double>, sigma2 double, n long"
    return sums.mapInPandas(lambda batches: map(run, batches), schema)


def ols(train: DataFrame, keys: list[str], x: list[str], y: str = "y") -> DataFrame:
    return _fit_groups(moments(train, keys, x, y), keys, x, lambda c, n: _solve(c))


def linear(x: list[str]) -> Column:
    """The prediction from joined coefficients."""
    out = F.col("intercept")
    for i, c in enumerate(x):
        out = out + F.col("beta")[i] * F.col(c)
    return out


def forecast(train: DataFrame, test: DataFrame, keys: list[str], model: str, x: list[str] | None = None) -> DataFrame:
    """Fixed-window forecasts (keys, day, model, y, y_pred) of a named linear model."""
    x = MODELS.get(model, x) if x is None else x
    if model == "LogHAR":
        logs = lambda df: df.withColumns({c: F.log(F.greatest(F.col(c), F.lit(1e-16))) for c in HAR} | {"ly": F.log(F.greatest(F.col("y"), F.lit(1e-16)))})
        fit = ols(logs(train), keys, HAR, "ly")
        scored = logs(test).join(fit, keys).withColumn("y_pred", F.exp(linear(HAR) + F.col("sigma2") / 2))
    else:
        scored = test.join(ols(train, keys, x), keys).withColumn("y_pred", linear(x))
    if model == "HARQ":
        ends = train.groupBy(*keys).agg(F.min("y").alias("low"), F.max("y").alias("high"))
        scored = scored.join(ends, keys).withColumn("y_pred", F.least(F.greatest("y_pred", "low"), F.col("high")))
    return scored.select(*keys, "day", F.lit(model).alias("model"), "y", "y_pred")


def standardised(rows: DataFrame, train: DataFrame, keys: list[str], x: list[str]) -> DataFrame:
    """Columns scaled by the training mean and population deviation (1 where it is 0)."""
    stats = train.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in x], *[F.stddev_pop(c).alias(f"s_{c}") for c in x])
    scaled = rows.join(stats, keys).withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in x})
    return scaled.drop(*[f"{p}_{c}" for c in x for p in "ms"])


# --- penalised regressions on the same sums --------------------------------------------------


def log_grid(low: float = 1e-5, high: float = 1e2, steps: int = 100) -> list[float]:
    return np.logspace(np.log10(low), np.log10(high), steps).tolist()


def _ridge(c: np.ndarray, n: int, lam: float) -> np.ndarray:
    a = c[:-1, :-1]
    return np.linalg.solve(a + lam * np.eye(len(a)), c[:-1, -1])


def _net(c: np.ndarray, n: int, lam: float, share: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent for (1/2n) squares + lam * (share * L1 + (1 - share)/2 * L2)."""
    a, b = c[:-1, :-1] / n, c[:-1, -1] / n
    w = np.zeros(len(b)) if start is None else start.copy()
    for _ in range(1000):
        most = 0.0
        for j in range(len(b)):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - lam * share, 0) / (a[j, j] + lam * (1 - share) or 1)
            most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-10 * max(1.0, np.abs(w).max()):
            break
    return w


def _post(c: np.ndarray, n: int, lam: float) -> np.ndarray:
    on = np.flatnonzero(_net(c, n, lam, 1.0))
    w = np.zeros(len(c) - 1)
    if len(on):
        w[on] = _solve(c[np.ix_([*on, -1], [*on, -1])])
    return w


def _adaptive(c: np.ndarray, n: int, lam: float, power: float = 1.0) -> np.ndarray:
    size = np.abs(_solve(c)) ** power + 1e-12
    d = np.append(size, 1.0)
    return _net(c * np.outer(d, d), n, lam, 1.0) * size


PENALISED = {
    "RR": lambda c, n, lam, share: _ridge(c, n, lam),
    "LA": lambda c, n, lam, share: _net(c, n, lam, 1.0),
    "EN": _net,
    "PLA": lambda c, n, lam, share: _post(c, n, lam),
    "ALA": lambda c, n, lam, share: _adaptive(c, n, lam),
}


def select_penalty(train: DataFrame, val: DataFrame, keys: list[str], x: list[str], kind: str, grid: list[float], shares: tuple[float, ...] = (1.0,)) -> DataFrame:
    """(keys, lam, share, val_mse, interior): the grid point of least validation error (the first on
    ties). Both samples enter as sums, in training units."""
    if kind not in PENALISED:
        raise ValueError(f"unknown model {kind!r}")
    solve, p = PENALISED[kind], len(x)
    zt, zv = standardised(train, train, keys, x), standardised(val, train, keys, x)
    a = moments(zt, keys, x)
    b = moments(zv, keys, x).select(*keys, F.col("n").alias("vn"), F.col("mean").alias("vmean"), F.col("cross").alias("vcross"))
    points = F.explode(F.array(*[F.struct(F.lit(i * len(shares) + j).alias("point"), F.lit(g).alias("lam"), F.lit(s).alias("share")) for i, g in enumerate(grid) for j, s in enumerate(shares)]))
    sums = cut(a.join(b, keys))  # a row per run
    tasks = sums.select("*", points.alias("_point")).select("*", "_point.*").drop("_point")
    tasks = dealt(tasks, sums.count() * len(grid) * len(shares), GRID_BATCH)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        errors = []
        for r in pdf.itertuples():
            c, v = np.array(r.cross).reshape(p + 1, p + 1), np.array(r.vcross).reshape(p + 1, p + 1)
            w = solve(c, r.n, r.lam, r.share)
            m, vm = np.array(r.mean), np.array(r.vmean)
            shift = (vm[-1] - m[-1]) - w @ (vm[:-1] - m[:-1])
            errors.append(float((v[-1, -1] - 2 * w @ v[:-1, -1] + w @ v[:-1, :-1] @ w) / r.vn + shift * shift))
        return pdf[[*keys, "point", "lam", "share"]].assign(val_mse=errors)

    kinds = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)
    scored = tasks.mapInPandas(lambda batches: map(run, batches), f"{kinds}, point int, lam double, share double, val_mse double")
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("lam", "share", "val_mse"), F.struct("val_mse", "point")).alias("s")).select(*keys, "s.*")
    return best.withColumn("interior", (F.col("lam") > min(grid)) & (F.col("lam") < max(grid)))


def penalised_forecast(train: DataFrame, val: DataFrame, test: DataFrame, keys: list[str], x: list[str], kind: str, grid: list[float], shares: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Select on validation, refit on both samples (rescaled on both), forecast the test rows."""
    chosen = select_penalty(train, val, keys, x, kind, grid, shares)
    both = train.unionByName(val)
    sums = moments(standardised(both, both, keys, x), keys, x).join(chosen, keys)
    solve, p = PENALISED[kind], len(x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        betas, starts = [], []
        for r in pdf.itertuples():
            c, m = np.array(r.cross).reshape(p + 1, p + 1), np.array(r.mean)
            w = solve(c, r.n, r.lam, r.share)
            betas.append(w.tolist())
            starts.append(float(m[-1] - w @ m[:-1]))
        return pdf[keys].assign(intercept=starts, beta=betas)

    kinds = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)
    fits = sums.mapInPandas(lambda batches: map(run, batches), f"{kinds}, intercept double, beta array<double>")
    scored = standardised(test, both, keys, x).join(fits, keys)
    return scored.select(*keys, "day", F.lit(kind).alias("model"), "y", linear(x).alias("y_pred"))


# --- rolling and expanding windows -----------------------------------------------------------


def rolling_forecast(rows: DataFrame, keys: list[str], x: list[str], window: int | str | None, refit: int = 1, embargo: int | Column = 0) -> DataFrame:
    """(keys, day, y, y_pred): one forecast per test row from least squares on its window; see
    ``rolling.rolling_models``."""
    return rolling_models(rows, keys, {"OLS": x}, window, refit, embargo).drop("model")


def coefficient_table(rows: DataFrame, keys: list[str], x: list[str]) -> DataFrame:
    """(keys, term, coefficient, robust_t): in-sample fit with heteroskedasticity-robust errors."""
    p = len(x)
    fit = ols(rows, keys, x)
    scored = rows.join(fit, keys).withColumn("u2", (F.col("y") - linear(x)) ** 2)
    one = [F.lit(1.0), *[F.col(c) for c in x]]
    bread = [F.sum(one[i] * one[j]) for i in range(p + 1) for j in range(p + 1)]
    meat = [F.sum(F.col("u2") * one[i] * one[j]) for i in range(p + 1) for j in range(p + 1)]
    sums = scored.groupBy(*keys).agg(F.array(*bread).alias("bread"), F.array(*meat).alias("meat")).join(fit, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            a = np.array(r.bread).reshape(p + 1, p + 1)
            scale = np.sqrt(np.diag(a))
            inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
            se = np.sqrt(np.maximum(np.diag(inverse @ np.array(r.meat).reshape(p + 1, p + 1) @ inverse), 0))
            for term, b, s in zip(["const", *x], [r.intercept, *r.beta], se, strict=True):
                out.append([*[getattr(r, k) for k in keys], term, float(b), float(b / s) if s > 0 else None])
        return pd.DataFrame(out, columns=[*keys, "term", "coefficient", "robust_t"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(lambda batches: map(run, batches), f"{kinds}, term string, coefficient double, robust_t double")
