"""Tail probabilities of the common test statistics, for the few rows that tests return."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, d, c = 1e-300, 1 - (a + b) * x / (a + 1), 1.0
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b)) * f


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    f = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * f


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_quantile(p: float) -> float:
    """The z with P(Z <= z) = p, by Newton steps on the error function."""
    if not 0 < p < 1:
        return math.nan
    z = 0.0 if 0.02 < p < 0.98 else math.copysign(2.2, p - 0.5)
    for _ in range(60):
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        gap = 0.5 * math.erfc(-z / math.sqrt(2)) - p
        move = max(-1.0, min(1.0, gap / max(density, 1e-300)))
        z -= move
        if abs(move) < 1e-14:
            break
    return z


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")


def t_quantile(confidence: float, df: float) -> float:
    """The t with P(|T| <= t) = confidence, by halving the range in which it lies."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - confidence and high < 1e12:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(middle, df) > 1 - confidence else (low, middle)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_critical(confidence: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided critical value of Student's t; null without degrees of freedom."""
    return _each(lambda p, d: t_quantile(p, d) if d > 0 and 0 < p < 1 else None, confidence, df)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return _each(lambda x, d: t_two_sided(x, d) if d > 0 else None, t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p of F."""
    return _each(lambda x, a, b: f_tail(x, a, b) if a > 0 and b > 0 else None, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper-tail p of chi-square."""
    return _each(lambda v, d: gamma_tail(d / 2, v / 2) if d > 0 else None, x, df)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@F.pandas_udf(T.DoubleType())
def normal_q(p: pd.Series) -> pd.Series:
    """Standard normal quantile."""
    return _each(normal_quantile, p)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of Fisher's exact test on [[a, b], [c, d]]: tables no likelier than the observed one."""

    def p(*cells: float) -> float:
        a, b, c, d = map(int, cells)
        n, row, col = a + b + c + d, a + b, a + c
        logs = lambda k: math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1) + math.lgamma(n - row + 1) - math.lgamma(col - k + 1) - math.lgamma(n - row - col + k + 1) - (math.lgamma(n + 1) - math.lgamma(col + 1) - math.lgamma(n - col + 1))
        seen = logs(a)
        return min(1.0, sum(math.exp(v) for k in range(max(0, row + col - n), min(row, col) + 1) if (v := logs(k)) <= seen + 1e-7))

    return _each(p, a, b, c, d)
