"""Scores and ranks as Columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Coefficients of a published rational approximation of the inverse normal distribution (|error| < 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    middle = _horner(r, _A) * q / (_horner(r, _B) * r + F.lit(1.0))
    tail = lambda x: _horner(x, _C) / (_horner(x, _D) * x + F.lit(1.0))
    low = tail(F.sqrt(F.lit(-2.0) * F.ln(p)))
    high = -tail(F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p)))
    return F.when((p <= 0) | (p >= 1), None).when(p < _LOW, low).when(p > 1 - _LOW, high).otherwise(middle)


def softmax(score: Column, *partition: str) -> Column:
    """Row softmax, stable for large scores."""
    w = Window.partitionBy(*partition)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null when one is null or has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clean_nan(score: Column) -> Column:
    """NaN as null, so that it is ranked last."""
    return F.when(~F.isnan(score), score)
