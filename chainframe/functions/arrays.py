"""Vector arithmetic on array columns, inside code generation (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def centred(x: Column) -> Column:
    """x less its mean."""
    return F.zip_with(x, F.array_repeat(total(x) / F.size(x), F.size(x)), lambda a, m: a - m)


def doubles(x: Column, n: int | None = None) -> Column:
    """x, or its first n entries, as doubles."""
    return F.transform(F.slice(x, 1, n) if n else x, lambda v: v.cast("double"))


def sum_vectors(name: str, dims: int, weight: Column | None = None) -> Column:
    """An aggregate: the weighted sum of array column `name` of known length, entry by entry."""
    entries = [F.col(name)[k] if weight is None else F.col(name)[k] * weight for k in range(dims)]
    return F.array(*[F.sum(x) for x in entries])


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, and a constant where b is 0."""
    return F.when(b == 0, F.lit(otherwise)).otherwise(F.try_divide(a, b))
