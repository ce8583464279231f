"""Numeric functions as Column expressions, and kernels for Arrow functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INFINITY), F.lit(False))


def sigmoid(x: Column) -> Column:
    return F.when(F.abs(x) < 50, 1 / (1 + F.exp(-x))).otherwise(F.when(x > 0, 1.0).otherwise(0.0))


def softplus(x: Column) -> Column:
    return F.when(x < 50, F.log1p(F.exp(x))).otherwise(x)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def logsumexp(xs: Column) -> Column:
    """log of the sum of exponentials, shifted by the maximum; a constant inside a lambda would be computed for each element, so it is zipped."""
    top = F.array_repeat(F.array_max(xs), F.size(xs))
    return F.array_max(xs) + F.log(total(F.zip_with(xs, top, lambda x, t: F.exp(x - t))))


def softmax(xs: Column) -> Column:
    z = F.array_repeat(logsumexp(xs), F.size(xs))
    return F.zip_with(xs, z, lambda x, z: F.exp(x - z))


def mass(logs: Column) -> Column:
    """Probability mass of tokens given by their log-probabilities."""
    return total(F.transform(logs, lambda x: F.exp(x)))


def sd_or_zero(x: Column) -> Column:
    """Sample standard deviation; 0 for a single value, null for none."""
    return F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x))


def percentile_at_floor(values: Column, q: float) -> Column:
    """The element at index floor(q n) of the sorted array, counted from 0."""
    return F.element_at(F.sort_array(values), F.least(F.floor(F.size(values) * q).cast("int") + 1, F.size(values)))


def hash_draw(bound: Column, *parts: Column) -> Column:
    """A number from 0 to ``bound`` - 1 drawn by the hash of the parts; any SQL engine can repeat it."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % bound


def _continued(a: float, b: float, x: float) -> float:
    """The continued fraction of the regularised incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _continued(b, a, 1.0 - x) / b


def t_survival(t: float | None, df: float | None) -> float:
    """P(T > t) of Student's t; NaN where t or df is missing or df is under 1."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df < 1:
        return float("nan")
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def log_softmax_rows(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True))
