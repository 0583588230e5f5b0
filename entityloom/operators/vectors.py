"""Fixed-width vectors per slot, as wide as the widest group.

A vector is cut into chunks of at most ``size`` cells, one row per slot and
chunk, so that no row holds a whole large group. Only cells that are present
are stored: the zeros up to the width follow from the one row of ``shape``, so
one hot key makes no other slot's vector larger. Moments and inner products are
taken from the stored cells alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from entityloom.functions import scalars
from entityloom.operators.moments import dot_product, masked_moments
from entityloom.operators.ordering import largest_group, slot_positions
from entityloom.plans.compile import feature_value
from entityloom.plans.spec import Component, Feature
from entityloom.sources.readers import require_columns

# Fixed value: cells per chunk.
CHUNK_CELLS = 8192


def pack_width(rows: DataFrame, key: str) -> int:
    """Cells per slot: the largest group, at least 1."""
    return max(largest_group(rows, key), 1)


def shape(slots: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row ``(slots, width, matched, padding)`` of the vectors of all slots.

    Counts of both sides meet in one aggregation per key and one over the keys.
    """
    sides = rows.select(key, F.lit(0).alias("_slot"), F.lit(1).alias("_row")).unionByName(
        slots.select(key, F.lit(1).alias("_slot"), F.lit(0).alias("_row"))
    )
    per_key = sides.groupBy(key).agg(F.sum("_slot").alias("_slots"), F.sum("_row").alias("_rows"))
    known = F.when(F.col("_slots") > 0, F.col("_rows"))
    stats = per_key.agg(
        F.coalesce(F.sum("_slots"), F.lit(0)).alias("slots"),
        F.greatest(F.max(known), F.lit(1)).alias("width"),
        F.coalesce(F.sum(known), F.lit(0)).alias("matched"),
    )
    return stats.withColumn("padding", padding(F.col("slots"), F.col("width"), F.col("matched")))


def padding(slots, width, matched):
    return slots * width - matched


def feature_rows(
    df: DataFrame, key: str, component: Component, feature: Feature, keep: Sequence[str]
) -> DataFrame:
    """The rows that make one feature's vectors: ``value``, ``mask`` and ``keep``.

    Rows without a value are left out. A difference keeps its two sides as
    ``value`` and ``right``; the mask is 1.0 inside the component's branch.
    """
    require_columns(df, [key, *keep, *feature.columns], component.id)
    mask = scalars.branch_mask(F.col(component.branch[0]), component.branch[1]) if component.branch else F.lit(1.0)
    if feature.transform == "difference":
        left, right = (replace(feature, transform="identity", sources=(c,)) for c in feature.columns)
        values = {"value": feature_value(df, left), "right": feature_value(df, right)}
    else:
        values = {"value": feature_value(df, feature)}
    rows = df.select(key, *keep, *[v.alias(n) for n, v in values.items()], mask.alias("mask"))
    return rows.dropna(subset=[key, *values])


def pack_vectors(
    slots: DataFrame,
    rows: DataFrame,
    key: str,
    values: Sequence[str],
    order: Sequence[str],
    index: str = "app_index",
    size: int = CHUNK_CELLS,
) -> DataFrame:
    """``(index, chunk, <values>, mask)`` with one array of present cells per value column.

    A slot without history has one row, chunk 0, with empty arrays. ``rows`` are the present rows of the history (missing ones compacted
    before); ``mask`` is 1.0 for a present cell unless ``values`` names a
    ``mask`` column of its own. ``order`` must be unique inside a key.
    """
    known = rows if "mask" in values else rows.withColumn("mask", F.lit(1.0))
    names = list(dict.fromkeys([*values, "mask"]))
    placed = slot_positions(known, key, order, "_slot").select(
        key,
        F.floor(F.col("_slot") / F.lit(size)).cast("int").alias("chunk"),
        F.struct("_slot", *[F.col(n).cast("double").alias(n) for n in names]).alias("_cell"),
    )
    packed = placed.groupBy(key, "chunk").agg(F.array_sort(F.collect_list("_cell")).alias("_cells"))
    stored = [F.coalesce(F.col("_cells").getField(n), F.array().cast("array<double>")).alias(n) for n in names]
    first = F.coalesce("chunk", F.lit(0)).alias("chunk")
    return slots.select(index, key).join(packed, key, "left").select(index, first, *stored)


def padded(packed: DataFrame, names: Sequence[str], width: int, size: int = CHUNK_CELLS) -> DataFrame:
    """The stored chunks with their zeros written out, up to ``size`` cells or the end of the vector.

    Chunks behind a slot's last cell hold nothing but zeros and are not made.
    """
    cells = F.least(F.lit(size), F.lit(width) - F.col("chunk") * F.lit(size))
    filled = {n: F.concat(n, F.array_repeat(F.lit(0.0), (cells - F.size(n)).cast("int"))) for n in names}
    return packed.withColumns(filled)


def packed_cells(packed: DataFrame, names: Sequence[str], index: str = "app_index") -> DataFrame:
    """One row per present cell; a slot without one has a row of missing values."""
    return packed.select(index, F.inline_outer(F.arrays_zip(*names)))


def packed_moments(
    packed: DataFrame, value: str, scale: int | None = None, index: str = "app_index", right: str | None = None
) -> DataFrame:
    """``(index, count, sum, sum_squares)`` of every slot's vector under its mask, ``right`` taken off if given.

    Zeros of the padding have mask 0 and add nothing, so only stored cells are read.
    """
    names = [value, "mask", *([right] if right else [])]
    cells = packed_cells(packed, names, index)
    values = F.col(value) - F.col(right) if right else F.col(value)
    found = masked_moments(cells, index, values, F.col("mask"), scale)
    return found.na.fill(0.0, ["count", "sum", "sum_squares"])


def packed_dot(
    packed: DataFrame, left: str, right: str, scale: int | None = None, index: str = "app_index"
) -> DataFrame:
    """``(index, dot)``: the inner product of two vectors of every slot, 0 without history."""
    cells = packed_cells(packed, [left, right], index)
    return dot_product(cells, index, F.col(left), F.col(right), scale).na.fill(0.0, ["dot"])


def manifest(packed: DataFrame, names: Sequence[str], shape_: DataFrame) -> DataFrame:
    """``(vector, elements, present)``: length and present cells of every flat vector."""
    present = packed.agg(*[F.coalesce(F.sum(F.size(n)), F.lit(0)).alias(n) for n in names])
    counted = present.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("vector"), F.col(n).alias("present")) for n in names]))
    )
    length = shape_.select(F.array_repeat(F.col("slots") * F.col("width"), len(names)).alias("_n"))
    lengths = length.select(F.posexplode("_n").alias("_at", "elements"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("_at") + 1)
    return counted.join(lengths.select(named.alias("vector"), "elements"), "vector")


def flatten_vectors(
    packed: DataFrame, name: str, width: int, index: str = "app_index", size: int = CHUNK_CELLS
) -> DataFrame:
    """Present cells as ``(position, value)`` with ``position = index * width + cell``."""
    cells = packed.select(index, "chunk", F.posexplode(name).alias("_at", "value"))
    base = F.col(index) * F.lit(width) + F.col("chunk") * F.lit(size)
    return cells.select((base + F.col("_at")).cast("bigint").alias("position"), "value")
