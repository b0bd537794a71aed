"""Vector functions over array columns; sums run left to right in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mcqlab.functions.text import bound


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    return bound(norm(a), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


def ambiguity(options: list[Column], correct: Column) -> Column:
    """Mean cosine of the correct option with the three others; 0 for a key that is none of a to d."""
    key, out = F.lower(correct), None
    for i, mark in enumerate("abcd"):
        others = [cosine(options[i], o) for j, o in enumerate(options) if j != i]
        mean = reduce(lambda x, y: x + y, others) / F.lit(3.0)
        out = F.when(key == mark, mean) if out is None else out.when(key == mark, mean)
    return out.otherwise(F.lit(0.0))
