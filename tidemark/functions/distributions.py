"""Student's t and normal distribution, as Arrow functions over columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z_975 = 1.959963984540054


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + top * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + top / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """P(|T| >= |t|)."""
    if t is None or df is None or df <= 0 or math.isnan(t) or math.isnan(df):
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float | None) -> float | None:
    """The t with P(T <= t) = p, by bisection."""
    if df is None or df <= 0 or math.isnan(df):
        return None
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_two_sided(mid, df) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(float(a), None if pd.isna(b) else float(b)) for a, b in zip(p, df, strict=True)], dtype="float64")
