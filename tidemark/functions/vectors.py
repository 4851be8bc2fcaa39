"""Distances between arrays of numbers, as higher-order expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Iterable[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null if the lengths differ or a number is missing."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(lengths, F.lit(0.0)))


def usable(vector: Column, width: int) -> Column:
    """Whether it has exactly ``width`` numbers, none missing or NaN."""
    return F.coalesce((F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
