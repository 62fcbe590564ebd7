"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def doubles(v: Column) -> Column:
    """A float vector as doubles."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of double vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a small constant against zero vectors."""
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    bound = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))
    return F.get(bound, F.lit(0))  # the length is the variable of a lambda, so it isn't computed again for each component
