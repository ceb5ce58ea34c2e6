"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """True for real numbers; false for null, NaN and the infinities."""
    size = F.abs(value)
    return value.isNotNull() & ~F.isnan(value) & (size < F.lit(float("inf")))


def finite_positive(value: Column) -> Column:
    return is_finite(value) & (value > 0)


def ceil_div(total: Column, step: Column) -> Column:
    """Whole steps that cover ``total``, in long arithmetic; null for step 0."""
    total, divisor = total.cast("long"), F.nullif(step.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", total, divisor) + F.when(F.pmod(total, divisor) > 0, 1).otherwise(0)


def geometric_points(low: Column, high: Column, count: int) -> Column:
    """``count`` points from ``low`` to ``high`` at equal ratios, ends exact."""
    step = (F.ln(high) - F.ln(low)) / F.lit(count - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.when(i == 0, low).when(i == count - 1, high).otherwise(F.exp(F.ln(low) + step * i)),
    )
