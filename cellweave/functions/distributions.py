"""Student-t and normal tail functions, vectorised over Arrow batches (no Spark built-in exists)."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by the classic continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1)
    safe = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    tiny = 1e-300
    c = np.ones_like(safe)
    d = 1 - (p + q) * safe / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)),
                          -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper quantile for p > 0.5 by bisection on the two-sided tail."""
    p, df = np.asarray(p, float), np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e8)
    for _ in range(200):
        mid = (low + high) / 2
        above = 1 - t_two_sided(mid, df) / 2 > p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return (low + high) / 2


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - math.erfc(mid / math.sqrt(2)) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _masked(function, *series: pd.Series) -> pd.Series:
    arrays = [s.to_numpy(dtype=float) for s in series]
    ok = np.all([np.isfinite(a) for a in arrays], axis=0)
    out = np.full(len(series[0]), np.nan)
    if ok.any():
        out[ok] = function(*[a[ok] for a in arrays])
    return pd.Series(out).astype(object).where(ok, None)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """0.975 quantile of Student's t."""
    return _masked(lambda d: t_quantile(np.full_like(d, 0.975), d), df)


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return _masked(normal_two_sided, z)
