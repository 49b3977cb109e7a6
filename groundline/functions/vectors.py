"""Vector expressions over arrays of floats, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Of unit length; a vector of length 0 is an error."""
    length = norm(v)
    return F.when(length == 0, F.raise_error(F.lit("a vector of length 0 has no direction"))).otherwise(F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has length 0."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of unit vectors."""
    return 1.0 - dot(a, b)


def nearest_rank(column: str, percent: float) -> Column:
    """Aggregate: the value at rank ceil(percent / 100 * n)."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column})")
