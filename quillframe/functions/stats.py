"""Interval and average helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; (0, 0) for n = 0."""
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = F.lit(0.0)
    return F.when(n > 0, F.greatest(none, centre - half)).otherwise(none), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(none)


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def lower_median(values: Column) -> Column:
    """The lower of the two middle values of an array."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) / 2).cast("int"))


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once for each row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
