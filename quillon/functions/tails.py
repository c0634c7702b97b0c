"""Tail probabilities of test statistics, a value a row (statistics are few: one a group)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction from the end where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def incomplete_gamma_tail(a: float, x: float) -> float:
    """1 - the regularised lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 100_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for k in range(1, 100_000):
        n = -k * (k - a)
        b += 2
        d, c = 1 / (n * d + b or tiny), b + n / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def correlation_p(rho: float, n: int) -> float | None:
    """Two-sided p of a rank correlation of n pairs by Student's t with n - 2 degrees of freedom."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    return 0.0 if abs(rho) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - rho * rho)


def normal_p(z: float) -> float | None:
    """Two-sided p of a standard normal."""
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: tables with its margins that are no likelier."""
    rows, cols, total = a + b, a + c, a + b + c + d
    x = np.arange(max(0, rows + cols - total), min(rows, cols) + 1)
    log = np.vectorize(math.lgamma, otypes=[float])
    p = -(log(x + 1.0) + log(rows - x + 1.0) + log(cols - x + 1.0) + log(total - rows - cols + x + 1.0))
    p = np.exp(p - p.max())
    return float(p[p <= p[x == a][0] * (1 + 1e-7)].sum() / p.sum())


def _of(function, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in zip(*values, strict=True)], dtype=float)

    return run(*columns)


def correlation_tail(rho: Column, n: Column) -> Column:
    return _of(correlation_p, rho, n)


def normal_tail(z: Column) -> Column:
    return _of(normal_p, z)


def chi_square_tail(x: Column, dof: Column) -> Column:
    return _of(lambda v, k: incomplete_gamma_tail(k / 2, v / 2), x, dof)


def fisher_tail(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _of(lambda *t: fisher_p(*map(int, t)), a, b, c, d)
