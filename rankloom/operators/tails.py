"""Distribution tails as Arrow UDFs in numpy; scipy is not needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _normal(z: pd.Series) -> pd.Series:
    """Two-sided normal p value."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else np.nan)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student p value."""
    return pd.Series([_incomplete_beta(n / 2, 0.5, n / (n + v * v)) if v == v and n == n else np.nan for v, n in zip(t, df)])


def _hypergeometric(x: pd.Series, m: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
    """P(at least x of the k drawn fall among m of n)."""

    def choose(a, b):
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def tail(x, m, k, n):
        return min(1.0, sum(math.exp(choose(m, i) + choose(n - m, k - i) - choose(n, k)) for i in range(int(max(x, k - (n - m))), int(min(m, k)) + 1)))

    return pd.Series([tail(*v) for v in zip(x, m, k, n)])


def _stirling_rest(n: float) -> float:
    """ln n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _half_binomial(x: int, n: int) -> float:
    """P(X = x) of n fair coins; the large logarithms are taken as deviances, so that digits do not go as n grows."""
    if x in (0, n):
        return math.exp(-n * math.log(2))
    away = sum(k * math.log1p((k - n / 2) / (n / 2)) - (k - n / 2) for k in (x, n - x))
    return math.sqrt(n / (2 * math.pi * x * (n - x))) * math.exp(_stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - away)


def _binomial(x: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided sign test against one half: the term at x and the ratios of those below, as far as they reach a double's last digit."""

    def p(x, n):
        if not n:
            return np.nan
        n = int(n)
        x = int(min(x, n - x))
        i = np.arange(x, max(0, x - 8 * math.isqrt(n) - 64), -1.0)
        return min(1.0, 2 * _half_binomial(x, n) * (1 + np.cumprod(i / (n - i + 1)).sum()))

    return pd.Series([p(a, b) for a, b in zip(x, n)])


def normal_p(z):
    return F.pandas_udf(_normal, "double")(z)


def student_p(t, df):
    return F.pandas_udf(_student, "double")(t, df)


def hypergeometric_p(x, m, k, n):
    return F.pandas_udf(_hypergeometric, "double")(x, m, k, n)


def binomial_p(x, n):
    return F.pandas_udf(_binomial, "double")(x, n)
