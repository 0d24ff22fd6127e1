"""Exact integer arithmetic and tolerant comparisons as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mul_div(a: Column, b: Column, c: Column) -> Column:
    """floor(a * b / c) of non-negative longs without overflow; null where c is 0."""
    wide = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    by = F.nullif(c.cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    # the quotient less the remainder is exact, where a decimal quotient would be rounded
    return ((wide - wide % by) / by).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    """a - b, 0 at least."""
    return F.greatest(a - b, F.lit(0))


def percent_scaled(side: Column, percent: Column) -> Column:
    """A side at a percentage held to 10..100: halves go up, 1 at least."""
    held = F.least(F.greatest(percent, F.lit(10)), F.lit(100))
    return F.greatest(F.floor((side * held + 50) / 100).cast("long"), F.lit(1))


def close_relative(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    """Equal up to a share of the larger magnitude, which counts as 1 at least."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def close_absolute(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance


def reduction_percent(before: Column, after: Column) -> Column:
    """How much smaller, in percent; null where there was nothing."""
    return (before - after) * 100.0 / F.nullif(before.cast("double"), F.lit(0.0))


def raw_image_bytes(w: Column, h: Column, bits: Column) -> Column:
    """Bytes of the pixels at three components each; null without a bit depth."""
    return F.floor(w * h * bits * 3 / 8).cast("long")
