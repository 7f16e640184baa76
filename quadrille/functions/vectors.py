"""Vector expressions over array columns; sums run in double and in order, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.binding import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalised(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return let(doubles(v), lambda d: let(l2_norm(d), lambda norm: F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(x))))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def mean_pool(parts: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    def pooled(p: Column) -> Column:
        total = F.aggregate(p, F.array_repeat(F.lit(0.0), F.size(F.get(p, F.lit(0)))), lambda acc, part: F.zip_with(acc, doubles(part), lambda x, y: x + y))
        return let(F.size(p), lambda n: F.transform(total, lambda x: x / n))

    return let(parts, pooled)
