"""Vector distances as JVM expressions over array<float> columns.

Vectors of different lengths are an error, a null vector gives null.  Smaller is closer in all three.
Sums run in double, in array order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    parts = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; a zero vector has no angle and gives NaN."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / F.when(norms > 0, norms)).otherwise(F.when(norms.isNotNull(), F.lit(float("nan"))))


METRICS = {"l2": l2, "cosine": cosine, "dot": negative_dot}
