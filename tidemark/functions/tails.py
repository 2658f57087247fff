"""Tail probabilities that Spark has no function for, as vectorised UDFs on test-result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series, side: pd.Series) -> pd.Series:
    """p-value of a t statistic; df 0 stands for the normal distribution."""
    t, df = t.to_numpy(float), df.to_numpy(float)
    normal = 0.5 * _erfc(t / math.sqrt(2))
    upper = np.where(df > 0, _t_upper(t, np.where(df > 0, df, 1.0)), normal)
    found = np.select([side == "greater", side == "less"], [upper, 1 - upper], 2 * np.minimum(upper, 1 - upper))
    return pd.Series(found).where(~np.isnan(t))


@pandas_udf(DoubleType())
def chi1_p(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    v = x.to_numpy(float)
    return pd.Series(_erfc(np.sqrt(np.where(v >= 0, v, 0) / 2))).where(v >= 0)


_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _t_upper(t, df):
    """Upper tail of Student's distribution, for arrays."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * _beta_share(df / 2, np.full(df.shape, 0.5), df / (df + t * t))
    return np.where(t > 0, half, 1 - half)


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by the modified Lentz continued fraction."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    whole = lambda v: np.where(v == 0, 1e-300, v)
    c, d = np.ones_like(y), 1 / whole(1 - (a + b) * y / (a + 1))
    value = d
    for m in range(1, 300):
        even = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / whole(1 + step * d)
            c = whole(1 + step / c)
            value = value * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    share = np.where(inside, front * value, x >= 1)
    return np.where(swap, 1 - share, share)
