"""Checks on keys, layouts and feature bundles. Each returns a small table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from entityloom.functions import fixedpoint as fx
from entityloom.functions.scalars import normalise_key

# Fixed value: entries hashed together per fingerprint block.
BLOCK = 65_536


def key_quality(df: DataFrame, key: str) -> DataFrame:
    """Rows, blank keys, unique keys, repeated keys and a verdict."""
    per_key = df.groupBy(normalise_key(F.col(key)).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    present = F.col("_key").isNotNull()
    quality = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~present, F.col("_n"))), F.lit(0)).alias("blank_rows"),
        F.count_if(present).alias("unique_keys"),
        F.count_if(present & (F.col("_n") > 1)).alias("repeated_keys"),
    )
    ok = (F.col("rows") > 0) & (F.col("blank_rows") == 0) & (F.col("repeated_keys") == 0)
    return quality.withColumn("valid", ok)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """The offending keys with their row counts."""
    per_key = df.groupBy(normalise_key(F.col(key)).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return per_key.filter(F.col("key").isNotNull() & (F.col("rows") > 1))


def require_unique_keys(df: DataFrame, key: str) -> DataFrame:
    """Raise when the key is not unique and non-blank; returns ``df`` unchanged."""
    q = key_quality(df, key).first()
    if not q["valid"]:
        raise ValueError(
            f"{key}: {q['rows']} rows, {q['blank_rows']} blank, {q['repeated_keys']} repeated keys"
        )
    return df


def dense_index_check(df: DataFrame, index: str = "app_index") -> DataFrame:
    """A dense index has minimum 0, maximum n-1 and n different values."""
    per_value = df.groupBy(index).agg(F.count(F.lit(1)).alias("_n"))
    stats = per_value.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.min(index).alias("lowest"),
        F.max(index).alias("highest"),
        F.count(index).alias("different"),
    )
    n = F.col("rows")
    dense = (F.col("lowest") == 0) & (F.col("highest") == n - 1) & (F.col("different") == n)
    return stats.withColumn("dense", F.coalesce(dense, F.lit(False)))


def ordered_key_agreement(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Do two numbered key lists hold the same keys at the same positions?"""
    a = left.select(key, F.col(position).alias("_l"))
    b = right.select(key, F.col(position).alias("_r"))
    joined = a.join(b, key, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    stats = joined.agg(
        F.count("_l").alias("left_rows"),
        F.count("_r").alias("right_rows"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(both & (F.col("_l") != F.col("_r"))).alias("moved"),
    )
    sets_differ = (F.col("left_only") > 0) | (F.col("right_only") > 0)
    verdict = (
        F.when(sets_differ, F.lit("sets differ"))
        .when(F.col("moved") > 0, F.lit("different orders"))
        .otherwise(F.lit("agree"))
    )
    return stats.withColumn("verdict", verdict)


def require_agreement(left: DataFrame, right: DataFrame, key: str, position: str) -> int:
    """Raise unless both lists agree; returns the number of keys."""
    row = ordered_key_agreement(left, right, key, position).first()
    if row["verdict"] != "agree":
        raise ValueError(
            f"{row['verdict']}: left_only={row['left_only']}, right_only={row['right_only']}"
        )
    return row["left_rows"]


def coverage_check(
    long: DataFrame, slots: int, expected: DataFrame | None = None, index: str = "app_index"
) -> DataFrame:
    """Is every output present exactly once for every slot?

    ``expected`` lists ``(component_id, feature, operation)`` that must occur;
    outputs outside the list and outputs without rows are both incomplete.
    """
    output = ["component_id", "feature", "operation"]
    per_cell = long.groupBy(*output, index).agg(F.count(F.lit(1)).alias("_n"))
    stats = per_cell.groupBy(*output).agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("slots"),
        F.min(index).alias("lowest"),
        F.max(index).alias("highest"),
    )
    known: Column = F.lit(True)
    if expected is not None:
        listed = expected.select(*output).withColumn("_listed", F.lit(True))
        stats = stats.join(listed, output, "full").fillna(0, subset=["rows", "slots"])
        known = F.col("_listed").isNotNull()
    n = F.lit(slots)
    full = (F.col("rows") == n) & (F.col("slots") == n)
    dense = (F.col("lowest") == 0) & (F.col("highest") == n - 1)
    complete = F.coalesce(known & full & dense, F.lit(False))
    return stats.select(*output, "rows", "slots", complete.alias("complete"))


def layout_fingerprint(df: DataFrame, index: str, key: str, block: int = BLOCK) -> DataFrame:
    """SHA-256 over the keys in index order, as one row ``(slots, fingerprint)``.

    One rule at every size: each slot is the hash of its index and key (with a
    mark that tells a missing key from a text), each block of ``block`` slots
    the hash of its slots' hashes, each block of blocks the hash of theirs, and
    the layout the hash of those. Only slots whose index is missing share a
    task by chance; they are spread by their hash.
    """
    cell = F.concat_ws(
        ":",
        F.coalesce(F.col(index).cast("string"), F.lit("?")),
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("?")),
    )
    level = df.select(F.col(index).cast("bigint").alias("_at"), F.sha2(cell, 256).alias("_t"), F.lit(1).alias("_n"))
    spread = -1 - F.pmod(F.xxhash64("_t"), F.lit(1 << 20))
    level = level.withColumn("_at", F.coalesce("_at", spread))
    for by in (F.floor(F.col("_at") / F.lit(block)), F.floor(F.col("_at") / F.lit(block)), F.lit(0)):
        cells = F.sort_array(F.collect_list(F.struct("_at", "_t")))
        level = level.groupBy(by.alias("_at")).agg(
            F.sha2(F.array_join(cells.getField("_t"), ""), 256).alias("_t"), F.sum("_n").alias("_n")
        )
    return level.select(F.col("_n").cast("bigint").alias("slots"), F.col("_t").alias("fingerprint"))


def bundle_compatibility(layouts: Mapping[str, DataFrame], index: str, key: str) -> DataFrame:
    """Slot count and layout fingerprint per bundle, and whether all of them agree."""
    if not layouts:
        raise ValueError("at least one bundle is required")
    rows = reduce(
        DataFrame.unionByName,
        [
            layout_fingerprint(layout, index, key).select(F.lit(name).alias("bundle"), "*")
            for name, layout in layouts.items()
        ],
    )
    everything = Window.partitionBy(F.lit(0))  # one row per bundle
    same = (F.min("slots").over(everything) == F.max("slots").over(everything)) & (
        F.min("fingerprint").over(everything) == F.max("fingerprint").over(everything)
    )
    return rows.withColumn("compatible", same)


def require_compatible(layouts: Mapping[str, DataFrame], index: str, key: str) -> None:
    rows = bundle_compatibility(layouts, index, key).collect()
    if not all(r["compatible"] for r in rows):
        counts = {r["slots"] for r in rows}
        what = "slot counts" if len(counts) > 1 else "slot layouts"
        raise ValueError(f"bundles have different {what}")


def tolerance_compare(
    expected: DataFrame, actual: DataFrame, on: str, value: str, tolerance: float = 1e-4
) -> DataFrame:
    """``(on, expected, actual, absolute_error, passed)`` for every expected row."""
    left = expected.select(on, F.col(value).cast("double").alias("expected"))
    right = actual.select(on, F.col(value).cast("double").alias("actual"))
    error = F.abs(F.col("expected") - F.col("actual"))
    return left.join(right, on, "left").select(
        on,
        "expected",
        "actual",
        error.alias("absolute_error"),
        F.coalesce(error <= F.lit(tolerance), F.lit(False)).alias("passed"),
    )


def tolerance_summary(details: DataFrame, actual_rows: int | None = None, scale: int = 9) -> DataFrame:
    """Rows checked, largest and mean error, and whether everything passed."""
    rows = details.withColumn("_u", fx.to_units(F.col("absolute_error"), scale))
    summary = rows.agg(
        F.count(F.lit(1)).alias("checked_rows"),
        F.max("absolute_error").alias("max_absolute_error"),
        F.expr(fx.mean("count(_u)", fx.exact_sum("_u"), scale)).alias("mean_absolute_error"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )
    if actual_rows is None:
        return summary
    return summary.withColumn("passed", F.col("passed") & (F.col("checked_rows") == actual_rows))
