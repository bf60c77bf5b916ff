"""Student's t and normal tails as vectorised functions (NumPy only)."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, in modified Lentz form."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / keep(1 - (p + q) * y / (p + 1))
    c, h = np.ones_like(y), d.copy()
    for m in range(1, 300):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / keep(1 + even * d), keep(1 + even / c)
        h *= d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / keep(1 + odd * d), keep(1 + odd / c)
        step = d * c
        h *= step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with df degrees of freedom; NaN where df isn't positive or t is missing."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    ok = (df > 0) & ~np.isnan(t)
    safe = np.where(ok, df, 1.0)
    x = safe / (safe + np.where(ok, t, 0.0) ** 2)
    return np.where(ok, incomplete_beta(safe / 2, np.full_like(safe, 0.5), x), np.nan)


def normal_cdf(x) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, dtype=float) / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _t_series(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float))).replace({np.nan: None})


def _cdf_series(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(x.to_numpy(dtype=float)))


@lru_cache
def _vectorised(name: str):
    """A pandas UDF, made when first used: that needs a session."""
    return F.pandas_udf({"t": _t_series, "cdf": _cdf_series}[name], "double")


def t_p_value(t, df):
    """The two-sided p value of a column of t statistics."""
    return _vectorised("t")(t, df)


def normal_cdf_udf(x):
    return _vectorised("cdf")(x)
