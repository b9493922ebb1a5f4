"""Numeric column helpers: rounding, safe division, percent truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """NumPy/pandas ``round(digits)``: half-even on ``x * 10**digits``.

    Spark's ``round`` is half-up on the decimal text (0.285 -> 0.29), NumPy gives 0.28; ``rint`` on the scaled
    double reproduces NumPy bit for bit (DuckDB: ``round_even(x*10^d, 0) / 10^d``).
    """
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def round2(c: Column | str) -> Column:
    return round_half_even(c, 2)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL for a zero or NULL denominator (ANSI mode makes ``/0`` an error)."""
    return F.try_divide(_c(num), _c(den))


def pct_trunc(share: Column | str) -> Column:
    """``int(x * 100)``: truncation toward zero, as a bigint (NULL for infinities, NaN and what exceeds one)."""
    x = _c(share) * F.lit(100.0)
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when(F.abs(x) < F.lit(9.2e18), whole)


def days_since_epoch(c: Column | str) -> Column:
    """Fractional days since 1970-01-01 for a date or timestamp column (timestamps keep their fraction)."""
    col = _c(c)
    return F.unix_micros(col.cast("timestamp")) / F.lit(86_400_000_000.0)
