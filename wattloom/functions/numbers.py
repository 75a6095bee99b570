"""Scalar expressions on numbers: coercion, masks, tolerance, clipping and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(c: Column) -> Column:
    """A double, null where the text isn't one."""
    return c.try_cast("double")


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def all_finite(*cols: str) -> Column:
    """Row mask: every column is finite."""
    return reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in cols])


def is_close(a: Column, b: Column | float, rel: float = 1e-5, absolute: float = 1e-8) -> Column:
    """|a - b| <= absolute + rel * |b|."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.abs(a - b) <= F.lit(absolute) + F.lit(rel) * F.abs(b)


def clip(c: Column, low: float, high: float) -> Column:
    """Values below ``low`` become it, above ``high`` that."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def level3(c: Column, low: Column | float, high: Column | float) -> Column:
    """LOW at or below ``low`` (also where both hold), HIGH at or above ``high``, else MEDIUM; null stays null."""
    return F.when(c <= low, "LOW").when(c >= high, "HIGH").when(c.isNotNull(), "MEDIUM")


def step_label(c: Column, steps: list[tuple[float, str]], last: str, strict: bool = True) -> Column:
    """The label of the first step the value is below (or at, if not ``strict``)."""
    w = None
    for bound, name in steps:
        hit = c < bound if strict else c <= bound
        w = F.when(hit, name) if w is None else w.when(hit, name)
    return w.when(c.isNotNull(), last)


def trend_label(c: Column, dead: float = 1e-9) -> Column:
    """UP, DOWN, or FLAT within a dead band."""
    return F.when(c > dead, "UP").when(c < -dead, "DOWN").when(c.isNotNull(), "FLAT")


def half_even(c: Column, digits: int) -> Column:
    """Rounding to even on ties."""
    return F.bround(c, digits)
