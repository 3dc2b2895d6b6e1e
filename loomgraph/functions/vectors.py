"""Vector arithmetic as Column expressions; values are summed as doubles.

Null, empty and wrong-width vectors give null, and a zero vector has no cosine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def constant(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _same(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def dot(a: Column, b: Column) -> Column:
    return F.when(_same(a, b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    return F.when(_same(a, b), _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def valid(a: Column, width: int) -> Column:
    """Of the expected width, with no null or NaN."""
    return a.isNotNull() & (F.size(a) == width) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x))


SPACES = {"cosine": cosine_distance, "l2": squared_l2, "ip": inner_product_distance}
