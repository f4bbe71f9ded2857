"""Vector distances as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "inner")


def _doubles(v: Column | list[float]) -> Column:
    return F.transform(v, lambda x: x.cast("double")) if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column | list[float]) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def normalized(a: Column) -> Column:
    """a scaled to length 1; a zero vector stays as it is."""
    size = magnitude(a)
    return F.when(size == 0, _doubles(a)).otherwise(F.transform(_doubles(a), lambda x: x / size))


def distance(a: Column, b: Column | list[float], metric: str = "l2") -> Column:
    """l2: root of squared differences; inner: minus the dot product; cosine: 1 - cosine, 2 where a vector is zero."""
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))
    if metric == "inner":
        return -dot(a, b)
    if metric != "cosine":
        raise ValueError(metric)
    sizes = magnitude(a) * (magnitude(b) if isinstance(b, Column) else F.lit(sum(float(x) ** 2 for x in b) ** 0.5))
    return F.when(sizes == 0, F.lit(2.0)).otherwise(1 - dot(a, b) / sizes)
