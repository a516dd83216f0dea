"""Expressions on arrays of doubles: entropy, norms, first largest element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(u: Column) -> Column:
    """Shannon entropy (natural logarithm), with shares held between 1e-12 and 1."""
    held = F.transform(u, lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))
    return -F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x * F.log(x))


def norm2(u: Column) -> Column:
    return F.sqrt(F.aggregate(u, F.lit(0.0), lambda acc, x: acc + x * x))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def first_max(u: Column) -> Column:
    """1-based place of the largest element, the first of equal ones."""
    return F.array_position(u, F.array_max(u)).cast("int")


def percent_effect(b: Column, step: float = 0.10) -> Column:
    """Percent change of a level for a step in a regressor of its logarithm."""
    return 100 * F.expm1(step * b)
