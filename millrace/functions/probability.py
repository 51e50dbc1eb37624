"""Distribution functions for small result tables.

Spark has no error function and no incomplete beta or gamma, so these are Arrow UDFs over vectors; they are meant
for rows that are already aggregated. Every tail is one integral over the density by Gauss-Legendre nodes, for all
rows of a batch at once. Upper tails are integrated themselves and not taken as 1 minus the rest, so small
probabilities keep their digits.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
#: Standard deviations from the middle beyond which a density is nothing in double precision.
_REACH = 13.0


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _integral(log_density, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Integral of exp(log_density(x, row)) from ``low`` to ``high``, row by row; ``high`` below ``low`` gives 0."""
    half = np.maximum(high - low, 0.0)[:, None] / 2
    x = low[:, None] + half * (1 + _NODES)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        inside = np.exp(log_density(x))
    return (np.where(np.isfinite(inside), inside, 0.0) * half) @ _WEIGHTS


def _normal_upper(z: np.ndarray) -> np.ndarray:
    """P(Z > z). For z above 0 this is the mean of exp(-z^2 / (2 sin^2 a)) over a quarter turn, halved."""
    a = (1 + _NODES) * math.pi / 4
    tail = np.exp(-np.square(z)[:, None] / (2 * np.square(np.sin(a)))) @ _WEIGHTS / 4
    return np.where(np.isnan(z), np.nan, np.where(z >= 0, tail, 1 - tail))


def _t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t): with t = sqrt(df) tan(a), an integral of cos(a)^(df - 1)."""
    edge = np.arctan(np.abs(t) / np.sqrt(df))
    end = np.minimum(math.pi / 2, edge + _REACH / np.sqrt(df))
    scale = _lgamma((df + 1) / 2) - _lgamma(df / 2) - math.log(math.pi) / 2
    tail = _integral(lambda a: (df - 1)[:, None] * np.log(np.cos(a)) + scale[:, None], edge, end)
    return np.where(np.isnan(t), np.nan, np.where(t >= 0, tail, 1 - tail))


def _chi2_tails(x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper tail: the square root s of the variable has a density near s = sqrt(k - 1) of unit width."""
    s = np.sqrt(np.maximum(x, 0.0))
    middle = np.sqrt(np.maximum(k - 1, 0.0))
    scale = (k / 2 - 1) * math.log(2) + _lgamma(k / 2)
    density = lambda v: (k - 1)[:, None] * np.log(v) - np.square(v) / 2 - scale[:, None]
    lower = _integral(density, np.minimum(np.maximum(middle - _REACH, 0.0), s), np.minimum(s, middle + _REACH))
    upper = _integral(density, np.maximum(s, middle - _REACH), np.maximum(s, middle) + _REACH)
    left = s <= middle
    return np.where(left, lower, 1 - upper), np.where(left, 1 - lower, upper)


def _udf(fn):
    """A vector function of one or two columns; a null in either gives null."""

    def one(x: pd.Series) -> pd.Series:
        return pd.Series(fn(x.to_numpy(dtype=float)))

    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(fn(x.to_numpy(dtype=float), y.to_numpy(dtype=float)))

    return lambda *cols: F.nullif(F.pandas_udf(one if len(cols) == 1 else two, "double")(*cols), F.lit(float("nan")))


def normal_cdf(z) -> Column:
    return _udf(lambda v: _normal_upper(-v))(z)


def normal_sf(z) -> Column:
    """Upper tail."""
    return _udf(_normal_upper)(z)


def normal_quantile(p: float) -> float:
    """Quantile of a plan-time constant."""
    return NormalDist().inv_cdf(p)


def _normal_ppf(p: np.ndarray) -> np.ndarray:
    inside = (p > 0) & (p < 1)
    out = np.full(p.shape, np.nan)
    out[inside] = np.vectorize(NormalDist().inv_cdf, otypes=[float])(p[inside]) if inside.any() else 0.0
    return out


def normal_ppf(p) -> Column:
    """Quantile; null outside 0 and 1."""
    return _udf(_normal_ppf)(p)


def t_cdf(t, df) -> Column:
    """Student t, for any degrees of freedom."""
    return _udf(lambda v, d: _t_upper(-v, d))(t, df)


def t_sf(t, df) -> Column:
    """Upper tail of Student t."""
    return _udf(_t_upper)(t, df)


def chi2_cdf(x, k) -> Column:
    return _udf(lambda v, d: _chi2_tails(v, d)[0])(x, k)


def chi2_sf(x, k) -> Column:
    """Upper tail of chi-square."""
    return _udf(lambda v, d: _chi2_tails(v, d)[1])(x, k)
