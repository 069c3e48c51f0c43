"""The distribution of Student's t, as a column expression where it is one and as an Arrow function else."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for 0 < x < 1, by its continued fraction, for many values at once."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x)))
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    logs = (_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)).astype(np.float64)
    front = np.exp(logs + a * np.log(x) + b * np.log1p(-x)) / a
    solid = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    value, c, d = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
    for k in range(400):
        m = k // 2
        if k == 0:
            term = np.ones_like(x)
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / solid(1 + term * d)
        c = solid(1 + term / c)
        value = value * c * d
        if not len(x.ravel()) or np.abs(1 - c * d).max() < 1e-15:
            break
    found = front * (value - 1)
    return np.where(turned, 1 - found, found)


def below(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """P(T <= t) of Student's t; not a number without a number or without freedom."""
    t, freedom = np.broadcast_arrays(np.asarray(t, np.float64), np.asarray(freedom, np.float64))
    out = np.where(np.isnan(t) | ~(freedom > 0), np.nan, np.where(t < 0, 0.0, np.where(t > 0, 1.0, 0.5)))
    inner = np.isfinite(t) & (t != 0) & (freedom > 0)
    x, n = t[inner], freedom[inner]
    share = n / (n + x * x)
    half = np.where(share > 0, incomplete_beta(n / 2, np.full_like(n, 0.5), np.clip(share, 1e-300, 1 - 1e-16)), 0.0) / 2
    out = np.array(out)
    out[inner] = np.where(x < 0, half, 1 - half)
    return out


def t_below(t: Column, freedom: Column) -> Column:
    """``below`` of two columns; null or no freedom gives null."""

    @F.pandas_udf("double")
    def values(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series(below(ts.to_numpy(np.float64), ns.to_numpy(np.float64)))

    return F.nanvl(values(t, freedom.cast("double")), F.lit(None))
