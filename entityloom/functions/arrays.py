"""Array kernels: dot product and masked moments over vectors held in one row.

All of them add strictly from left to right and reject empty vectors and
vectors of unequal length.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _checked(result: Column, *vectors: Column) -> Column:
    sizes = [F.size(v) for v in vectors]
    same = F.lit(True)
    for other in sizes[1:]:
        same = same & (sizes[0] == other)
    return (
        F.when(~same, F.raise_error(F.lit("vectors must be of one length")))
        .when(sizes[0] <= 0, F.raise_error(F.lit("vectors must not be empty")))
        .otherwise(result)
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    left, right = _doubles(left), _doubles(right)
    return _checked(_total(F.zip_with(left, right, lambda a, b: a * b)), left, right)


def moments(values: Column, mask: Column) -> Column:
    """Struct ``(count, sum, sum_squares)`` of ``values`` under ``mask``."""
    values, mask = _doubles(values), _doubles(mask)
    weighted = F.zip_with(values, mask, lambda x, m: m * x)
    squared = F.zip_with(values, mask, lambda x, m: m * x * x)
    stats = F.struct(
        _total(mask).alias("count"),
        _total(weighted).alias("sum"),
        _total(squared).alias("sum_squares"),
    )
    return _checked(stats, values, mask)


def difference_moments(left: Column, right: Column, mask: Column) -> Column:
    """Moments of ``left - right`` under ``mask``."""
    left, right, mask = _doubles(left), _doubles(right), _doubles(mask)
    gap = F.zip_with(left, right, lambda a, b: a - b)
    return _checked(moments(gap, mask), left, right, mask)


def linear_score(features: Column, weights: Column, bias: float = 0.0) -> Column:
    return F.lit(float(bias)) + dot(features, weights)
