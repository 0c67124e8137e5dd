"""Upper tail of the F distribution for small result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 10_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f is None or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    a, b, x = df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)
    y = df1 * f / (df2 + df1 * f)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(y)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def f_tail_column(f: str, df1: str, df2: str) -> Column:
    """``f_tail`` for result tables with one row per test."""

    @F.pandas_udf(DoubleType())
    def tail(fs: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.Series:
        return pd.Series([f_tail(*row) for row in zip(fs, firsts, seconds)], dtype="float64")

    return tail(f, df1, df2)
