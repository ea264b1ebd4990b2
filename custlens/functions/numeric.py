"""Deterministic numeric helpers shared by the library and its SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column | str, digits: int = 4) -> Column:
    """Round a double half-away-from-zero on its decimal value.

    The value is first brought to 9 decimals (``decimal(38,9)``), then
    rounded, so that tiny binary noise from different summation orders does
    not flip the last kept digit.  ``try_cast`` maps NaN/inf to NULL instead
    of failing under ANSI mode.  The SQL twin is
    ``CAST(round(TRY_CAST(x AS DECIMAL(38,9)), d) AS DOUBLE)``.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.try_cast("decimal(38,9)"), digits).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` that yields NULL for a zero divisor (ANSI mode raises)."""
    return F.try_divide(a, b)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
