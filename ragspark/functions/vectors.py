"""Vector expressions (I1-I3, A18); all in the JVM, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """One literal array, not an expression an element."""
    return F.lit([float(v) for v in values])


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null where either is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalize(v: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(as_double(v), lambda x: x / n)


def rounded(v: Column, places: int = 6) -> Column:
    """The stored form of a vector."""
    return F.transform(as_double(v), lambda x: F.round(x, places))


def parse(text: Column) -> Column:
    """`[0.1,-2e-3]` to an array of floats; null if it is none."""
    return F.from_json(text, "array<float>")
