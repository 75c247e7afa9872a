"""Special functions and Fisher's exact test, as Arrow-batched functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def gamma_p(s: float, z: float) -> float:
    """Regularised lower incomplete gamma function: a series near zero, else a continued fraction."""
    if z <= 0:
        return 0.0
    scale = math.exp(s * math.log(z) - z - math.lgamma(s))
    if z < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return total * scale
    b, c, d = z + 1 - s, 1e300, 1 / (z + 1 - s)
    h = d
    for k in range(1, 500):
        a = -k * (k - s)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= (step := c * d)
        if abs(step - 1) < 1e-15:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            top = 1.0
        elif k % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= (step := c * d)
        if abs(1 - step) < 1e-15:
            break
    return front * (f - 1)


def fisher(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float, float]:
    """(p of the table, left, right, two-sided)."""
    row, col, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    lo, hi = max(0, row + col - n), min(row, col)
    p = [math.exp(ln(row, k) + ln(n - row, col - k) - ln(n, col)) for k in range(lo, hi + 1)]
    own = p[n11 - lo]
    return own, min(1.0, sum(p[: n11 - lo + 1])), min(1.0, sum(p[n11 - lo :])), min(1.0, sum(x for x in p if x <= own * (1 + 1e-8)))


@pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)


@pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


@pandas_udf(T.DoubleType())
def gammap(s: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([gamma_p(a, b) for a, b in zip(s, z)])


@pandas_udf(T.DoubleType())
def gammaq(s: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([1 - gamma_p(a, b) for a, b in zip(s, z)])


@pandas_udf(T.DoubleType())
def betai(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([beta_i(*v) for v in zip(a, b, x)])


@pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("p", "left", "right", "two")]))
def fisher_exact(n11: pd.Series, n12: pd.Series, n21: pd.Series, n22: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fisher(*map(int, v)) for v in zip(n11, n12, n21, n22)], columns=["p", "left", "right", "two"])
