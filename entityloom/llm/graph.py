"""Connected components of a written edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityloom.session import materialise, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _to_least(pairs: DataFrame) -> DataFrame:
    """Every pair (a, b) with the least of ``a`` and its partners as ``m``."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(a, root) of every node with an edge but the roots themselves.

    ``edges`` has columns a and b of one ordered type, in any direction. Roots
    are the smallest nodes. Each round links every node's larger partners, then
    its smaller ones, to the smallest known; minima merge map-side and the
    joins are left to Spark, which splits hot nodes. Rounds grow with the
    logarithm of the longest chain; each is written to the shared folder.
    """
    current = materialise(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _to_least(large.filter("a <> b").distinct())
        linked = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        following = materialise(linked, "edges")
        release(current)
        current, after = following, _state(following)
        if after == before:
            break
        before = after
    return current.select("a", F.col("b").alias("root"))
