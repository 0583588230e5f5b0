"""Row-level aggregate kernels: masked moments and dot products per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from entityloom.functions import fixedpoint as fx


def masked_moments(df: DataFrame, key: str, value: Column, mask: Column, scale: int | None = None) -> DataFrame:
    """``count, sum, sum_squares`` of the value under a 0/1 mask, per key.

    With a ``scale`` the statistics are exact; without one they are doubles.
    """
    if scale is None:
        rows = df.select(key, value.cast("double").alias("_x"), mask.cast("double").alias("_m"))
        sums = {"count": "sum(_m)", "sum": "sum(_m * _x)", "sum_squares": "sum(_m * _x * _x)"}
        return rows.groupBy(key).agg(*[F.expr(e).alias(n) for n, e in sums.items()])
    rows = df.select(key, F.when(mask == 1.0, fx.to_units(value, scale)).alias("_u"))
    parts = {"n": "count(_u)", "s": f"coalesce({fx.exact_sum('_u')}, 0.0D)", **fx.square_sums("_u", *fx.limbs("_u"))}
    sums = rows.groupBy(key).agg(*[F.expr(e).alias(f"_{n}") for n, e in parts.items()])
    squares = fx.combined_squares("_hi", "_lo", "_ssw", "_ssd")
    return sums.selectExpr(
        key,
        "cast(_n AS double) AS count",
        f"{fx.from_units('_s', scale)} AS sum",
        f"{fx.from_units(squares, 2 * scale)} AS sum_squares",
    )


def difference_moments(
    df: DataFrame, key: str, left: Column, right: Column, mask: Column, scale: int | None = None
) -> DataFrame:
    return masked_moments(df, key, left - right, mask, scale)


def dot_product(
    df: DataFrame, key: str, left: Column, right: Column, scale: int | None = None, alias: str = "dot"
) -> DataFrame:
    """``sum(left * right)`` per key; ``scale`` is the number of decimals of the product."""
    product = left.cast("double") * right.cast("double")
    if scale is None:
        return df.groupBy(key).agg(F.sum(product).alias(alias))
    rows = df.select(key, fx.to_units(product, scale).alias("_u"))
    return rows.groupBy(key).agg(F.expr(fx.from_units(fx.exact_sum("_u"), scale)).alias(alias))


def chunked_dot_product(
    cells: DataFrame, key: str, position: str, left: Column, right: Column, size: int, scale: int
) -> DataFrame:
    """Dot product through one partial sum per vector chunk of ``size`` positions."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    chunk = F.floor(F.col(position) / F.lit(size)).alias("chunk")
    units = fx.to_units(left.cast("double") * right.cast("double"), scale)
    products = cells.select(key, chunk, units.alias("_u"))
    partial = products.groupBy(key, "chunk").agg(*[F.expr(e).alias(n) for n, e in fx.sums(*fx.limbs("_u")).items()])
    whole = fx.total("sum(s)", "sum(wh)")
    return partial.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"), F.expr(fx.from_units(f"({whole})", scale)).alias("dot")
    )


def finalise(stats: DataFrame, count: str, total: str, squares: str) -> DataFrame:
    """Add mean and clamped sample variance to double sufficient statistics."""
    return stats.withColumns(
        {
            "mean": F.expr(fx.mean(count, total, 0)),
            "var": F.expr(fx.moment_variance(count, total, squares)),
        }
    )


def presence(stats: DataFrame, slot: str, count: str, alias: str = "source_present") -> DataFrame:
    """1 for a slot that has a positive count in any of its statistics rows."""
    return stats.groupBy(slot).agg(F.max((F.col(count) > 0).cast("int")).alias(alias))
