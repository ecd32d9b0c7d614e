"""Rounding and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled binary value; NULL, NaN and infinities become NULL."""
    scale = F.lit(float(10**digits))
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return F.rint(finite.cast("double") * scale) / scale + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def settled(value: Column, digits: int = 0, noise: int = 6) -> Column:
    """``half_even`` of a long float sum: the last bits depend on the order of addition, so noise beyond
    ``noise`` digits is settled first and a sum that ends in exactly 5 rounds alike on every run."""
    return half_even(half_even(value, noise), digits)
