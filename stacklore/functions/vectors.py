"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; missing or null members count as 0."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column) -> Column:
    """The vector at length 1; zeros stay zeros."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)
