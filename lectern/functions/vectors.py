"""Vector expressions over ``array<float>`` columns.

Sums run in double, component by component in order. The block search in
``lectern.operators.search`` adds up in the same order, so both give the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Inner product. Arrays of unequal length give null."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity in [-1, 1]; null where it is undefined (zero vector, null, NaN)."""
    squares = dot(left, left) * dot(right, right)
    score = F.try_divide(dot(left, right), F.sqrt(squares))

    def clamped(x: Column) -> Column:
        return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))

    # The array of one gives the score a name, so that it is worked out once.
    return F.get(F.transform(F.array(score), clamped), F.lit(0))
