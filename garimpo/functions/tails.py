"""Tail probabilities of the usual test distributions.

Spark has no such functions. They run on result rows (one per test), vectorised over Arrow.
Incomplete gamma and beta follow the textbook series and continued fractions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = acc = 1.0 / a
        n = a
        while abs(term) > abs(acc) * 1e-16:
            n += 1
            term *= x / n
            acc += term
        return max(0.0, 1.0 - front * acc)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_lower(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + step * d or _TINY)
            c = 1 + step / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def chi2_tail(x: float, dof: float) -> float:
    return _gamma_upper(dof / 2, x / 2)


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else _beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, dof: float) -> float:
    return _beta_lower(dof / 2, 0.5, dof / (dof + t * t))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _column(function, *args: Column) -> Column:
    @F.pandas_udf("double")
    def tail(*series: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if any(v is None or math.isnan(v) for v in row) else function(*row)
                for row in zip(*series)
            ],
            dtype="float64",
        )

    return tail(*[a.cast("double") for a in args])


def chi2_p(x: Column, dof: Column) -> Column:
    return _column(chi2_tail, x, dof)


def f_p(x: Column, d1: Column, d2: Column) -> Column:
    return _column(f_tail, x, d1, d2)


def t_p(t: Column, dof: Column) -> Column:
    return _column(t_two_sided, t, dof)


def normal_p(z: Column) -> Column:
    """Upper tail of the standard normal."""
    return _column(normal_tail, z)
