"""Column functions on float vectors.  Sums run in double.

A shorter vector counts as filled up with zeros in a product, and each norm is
taken over the vector's own length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda a: a.cast("double") * a.cast("double"))))


def cosine(x: Column, y: Column, norm_x: Column | None = None, norm_y: Column | None = None) -> Column:
    """Cosine, 0 where a vector has norm 0; norms may be given."""
    size = (norm(x) if norm_x is None else norm_x) * (norm(y) if norm_y is None else norm_y)
    return F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))


def l2(x: Column, y: Column) -> Column:
    def square(a: Column, b: Column) -> Column:
        gap = F.coalesce(a.cast("double"), F.lit(0.0)) - F.coalesce(b.cast("double"), F.lit(0.0))
        return gap * gap

    return F.sqrt(_sum(F.zip_with(x, y, square)))
