"""Numeric building blocks as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x: Num | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp that passes NaN through (Spark orders NaN above every number)."""
    x = col(x)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def quantize(x: Num | str, steps: int) -> Column:
    """Integer code of a unit-interval value, halves up."""
    return F.floor(clamp(x) * float(steps) + 0.5).cast("int")


def snap(x: Num | str, steps: int = 65_535) -> Column:
    """Round to a fixed grid, so that results agree bit for bit between runs."""
    return quantize(x, steps) / float(steps)


def as_float32(x: Num | str) -> Column:
    """Round through single precision."""
    return col(x).cast("float").cast("double")


def finite(x: Num | str) -> Column:
    x = col(x)
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def dot(row: tuple[float, ...], rgb: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(float(k)) * c for k, c in zip(row, rgb, strict=True)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
