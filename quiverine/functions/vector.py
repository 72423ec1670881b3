"""Column functions over vectors (arrays of numbers), computed in doubles.

All are built-in higher-order functions, so they stay in the JVM. Functions of
two vectors raise if the lengths differ; a null vector gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs

ColumnLike = Column | str


def _vector(v: ColumnLike) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(values) -> Column:
    """A vector of driver-side numbers (a list or a numpy row)."""
    own = [float(x) for x in values]
    if any(not math.isfinite(x) for x in own):
        raise InvalidArgs("a vector holds a NaN or an infinity")
    return F.array(*map(F.lit, own)) if own else F.array().cast("array<double>")


def _same_size(x: Column, y: Column, value: Column) -> Column:
    message = F.format_string("vectors of %d and %d elements", F.size(x), F.size(y))
    return F.when(x.isNull() | y.isNull(), None).when(F.size(x) != F.size(y), F.raise_error(message)).otherwise(value)


def total(v: ColumnLike) -> Column:
    """The sum of the elements; 0 for an empty vector."""
    return F.aggregate(_vector(v), F.lit(0.0), lambda s, x: s + x)


def dot(x: ColumnLike, y: ColumnLike) -> Column:
    """The inner product; 0 for empty vectors."""
    x, y = _vector(x), _vector(y)
    return _same_size(x, y, total(F.zip_with(x, y, lambda a, b: a * b)))


def squared_distance(x: ColumnLike, y: ColumnLike) -> Column:
    """The squared Euclidean distance."""
    x, y = _vector(x), _vector(y)
    return _same_size(x, y, total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def max_abs(v: ColumnLike) -> Column:
    """The largest absolute element; null for an empty vector."""
    return F.array_max(F.transform(_vector(v), lambda x: F.abs(x)))


def smallest(v: ColumnLike) -> Column:
    """The smallest element; null for an empty vector."""
    return F.array_min(_vector(v))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, not wherever a lambda mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def norm2(v: ColumnLike) -> Column:
    """The Euclidean norm, safe from overflow and underflow; 0 for empty and zero vectors."""
    v = _vector(v)
    bound = F.struct(v.alias("v"), max_abs(v).alias("most"))
    scaled = _once(bound, lambda b: F.sqrt(F.aggregate(b["v"], F.lit(0.0), lambda s, x: s + (x / b["most"]) * (x / b["most"]))) * b["most"])
    return F.when(v.isNull(), None).when(F.coalesce(max_abs(v), F.lit(0.0)) == 0, 0.0).otherwise(scaled)


def add(x: ColumnLike, y: ColumnLike) -> Column:
    """The elementwise sum."""
    x, y = _vector(x), _vector(y)
    return _same_size(x, y, F.zip_with(x, y, lambda a, b: a + b))


def subtract(x: ColumnLike, y: ColumnLike) -> Column:
    """The elementwise difference."""
    x, y = _vector(x), _vector(y)
    return _same_size(x, y, F.zip_with(x, y, lambda a, b: a - b))


def scale(v: ColumnLike, factor: Column | float) -> Column:
    """Each element times ``factor``."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_vector(v), lambda x: x * factor)


def normalize(v: ColumnLike) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    v = _vector(v)
    bound = F.struct(v.alias("v"), norm2(v).alias("norm"))
    return _once(bound, lambda b: F.when(b["norm"] > 0, F.transform(b["v"], lambda x: x / b["norm"])).otherwise(b["v"]))


def divide(v: ColumnLike, divisions: int, vector_size: int) -> Column:
    """The vector cut into ``divisions`` slices of equal width, as an array of vectors."""
    if divisions < 1 or vector_size < 1 or vector_size % divisions:
        raise InvalidArgs(f"vectors of {vector_size} elements can't be cut into {divisions} equal divisions")
    width = vector_size // divisions
    v = _vector(v)
    return F.array(*(F.slice(v, d * width + 1, width) for d in range(divisions)))


def chunk(flat: ColumnLike, vector_size: int) -> Column:
    """A flat array cut into vectors of ``vector_size``; raises if elements are left over."""
    if vector_size < 1:
        raise InvalidArgs("vector_size must be positive")
    flat = F.col(flat) if isinstance(flat, str) else flat
    n = F.size(flat)
    cut = F.transform(F.sequence(F.lit(0), F.floor(n / vector_size).cast("int") - 1), lambda k: F.slice(flat, k * vector_size + 1, vector_size))
    odd = F.raise_error(F.format_string(f"%d elements do not make vectors of {vector_size}", n))
    return F.when(flat.isNull(), None).when(n % vector_size != 0, odd).when(n == 0, F.slice(F.array(flat), 1, 0)).otherwise(cut)
