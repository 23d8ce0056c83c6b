"""Circular intervals (bearings, degrees) and linear ones (metres) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 360.0


def circular_contains(lb: Column, ub: Column, deg: Column) -> Column:
    return (ub - lb >= FULL) | (F.pmod(deg - lb, F.lit(FULL)) <= F.pmod(ub - lb, F.lit(FULL)))


def circular_excess(lb: Column, ub: Column, deg: Column) -> Column:
    """Degrees to the nearer bound, 0 inside."""
    return F.when(circular_contains(lb, ub, deg), 0.0).otherwise(F.least(F.pmod(lb - deg, F.lit(FULL)), F.pmod(deg - ub, F.lit(FULL))))


def linear_contains(lb: Column, ub: Column, v: Column) -> Column:
    return (v >= lb) & (v <= ub)


def linear_excess(lb: Column, ub: Column, v: Column) -> Column:
    return F.greatest(lb - v, v - ub, F.lit(0.0))


def widen(lb: Column, ub: Column, by) -> tuple[Column, Column]:
    return lb - by, ub + by
