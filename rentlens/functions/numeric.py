"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.abs(c) < float("inf"), c)


def null_outside(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Values outside ``[lo, hi]`` become null; a bound of None is open."""
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (c < lo)
    if hi is not None:
        bad = bad | (c > hi)
    return F.when(bad, F.lit(None)).otherwise(c)


def within(c: Column, lo=None, hi=None) -> Column:
    """Clamp a value that is never null to ``[lo, hi]``; evaluates ``c`` once."""
    if hi is not None:
        c = F.least(c, hi if isinstance(hi, Column) else F.lit(hi))
    if lo is not None:
        c = F.greatest(c, lo if isinstance(lo, Column) else F.lit(lo))
    return c


def clip(c: Column, lo=None, hi=None) -> Column:
    """Clamp to ``[lo, hi]``; null stays null, which ``greatest`` and ``least`` alone do not give."""
    return F.when(c.isNotNull(), within(c, lo, hi))


def safe_ratio(numerator: Column, denominator: Column, otherwise: Column | None = None) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``otherwise`` (null)."""
    fallback = F.lit(None).cast("double") if otherwise is None else otherwise
    return F.when(denominator > 0, numerator / denominator).otherwise(fallback)


def round_even(c: Column, digits: int = 0) -> Column:
    """Round half to even; whole numbers by ``rint``, which needs no decimal arithmetic."""
    return F.rint(c) if digits == 0 else F.bround(c, digits)


def weighted_mean(parts: Sequence[tuple[float, Column]]) -> Column:
    """Mean of the non-null parts with their weights scaled to sum to one."""
    total = weight = F.lit(0.0)
    for w, value in parts:
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def date_parts(c: Column) -> dict[str, Column]:
    """Month, weekday (Monday 0) and quarter of an ISO date text; unparsable gives null."""
    day = c.try_cast("date")
    return {
        "post_month": F.month(day).cast("double"),
        "post_dayofweek": F.weekday(day).cast("double"),
        "post_quarter": F.quarter(day).cast("double"),
    }
