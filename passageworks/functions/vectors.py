"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(u: Column) -> Column:
    return F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(u: Column, v: Column) -> Column:
    """D3: ``1 - cos(u, v)``; null if either vector has zero length."""
    return F.lit(1.0) - dot(u, v) / F.nullif(norm(u) * norm(v), F.lit(0.0))
