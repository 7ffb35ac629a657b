"""Tail probabilities for result rows (t, F, chi-square, normal) as Arrow UDFs.

They run on the few rows a test returns, never on panel rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete beta continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def beta_tail(a: float, b: float, x: float) -> float:
    """1 - beta_reg, without loss for small tails."""
    if x <= 0.0 or x >= 1.0:
        return 1.0 if x <= 0.0 else 0.0
    if x >= (a + 1.0) / (a + b + 2.0):
        log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
        return math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b
    return 1.0 - beta_reg(a, b, x)


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    out = d
    for i in range(1, 10000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out * math.exp(log_front)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(x: float, df: float) -> float:
    return gamma_tail(df / 2.0, x / 2.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    if x <= 0.0:
        return 1.0
    return beta_tail(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2))


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    half = 0.5 * beta_reg(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def _each(fn, *series: pd.Series) -> pd.Series:
    def one(args):
        if any(a is None or math.isnan(a) for a in args):
            return np.nan
        if any(math.isinf(a) for a in args):
            return 0.0 if args[0] > 0 else 1.0
        return fn(*args)

    return pd.Series([one(args) for args in zip(*series)], dtype="float64")


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return _each(normal_sf, z)


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def _f_tail(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_sf, x, d1, d2)


@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_sf, t, df)


def _call(udf, *args: Column) -> Column:
    out = udf(*[a.cast("double") for a in args])
    return F.when(F.isnan(out), None).otherwise(out)


def normal_tail(z: Column) -> Column:
    return _call(_normal_tail, z)


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))


def chi2_tail(x: Column, df: Column) -> Column:
    return _call(_chi2_tail, x, df)


def chi2_tail_even(x: Column, df: int) -> Column:
    """Closed form for an even number of degrees of freedom; stays in the JVM."""
    half = x / 2
    term = total = F.lit(1.0)
    for k in range(1, df // 2):
        term = term * half / k
        total = total + term
    return F.exp(-half) * total


def f_tail(x: Column, d1: Column, d2: Column) -> Column:
    return _call(_f_tail, x, d1, d2)


def t_tail(t: Column, df: Column) -> Column:
    return _call(_t_tail, t, df)


def t_two_sided(t: Column, df: Column) -> Column:
    return F.least(F.lit(1.0), 2 * t_tail(F.abs(t), df))
