"""The three ways in which the metrics divide, and sketches of a column of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null over nothing, six decimals."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def rate(a: Column, b: Column) -> Column:
    """One over nothing, six decimals."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0)), 6)


def share(a: Column, b: Column) -> Column:
    """Zero over nothing, not rounded."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def agreement(a: Column, b: Column) -> Column:
    """Of two counts: null if one is null, 1 if equal, 0 if one is 0, else the lesser over the greater."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.round(F.least(a, b).cast("double") / F.greatest(a, b), 6))


def f1(p: Column, r: Column) -> Column:
    """Of a precision and a recall that are rounded already; null if both are 0."""
    return F.when(p + r > 0, F.round(2 * p * r / (p + r), 6))


def mean_or_zero(x: Column, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)), digits)


def numbers(x: Column, name: str) -> list[Column]:
    """count, min, p50, p90, max, mean."""
    q = lambda p: F.round(F.percentile(x, p), 6)
    made = {"count": F.count(x), "min": F.min(x), "p50": q(0.5), "p90": q(0.9), "max": F.max(x), "mean": F.round(F.avg(x), 6)}
    return [v.alias(f"{name}_{k}") for k, v in made.items()]
