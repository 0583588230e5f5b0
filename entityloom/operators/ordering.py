"""Order-dependent operators without single-task windows.

Two ways to number or accumulate rows in a global order:

* a hash order is cut into buckets by the leading digits of the digest, which
  are uniform by construction, so each bucket is a small window and only the
  bucket sizes are accumulated;
* a key order is range-sorted once and written to the shared folder, so that
  the row positions are fixed; only one total per written partition is
  accumulated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from entityloom.functions import fixedpoint as fx
from entityloom.session import materialise

# Digest digits that name a hash bucket (16^4 buckets) and bits of
# the in-partition counter of monotonically_increasing_id.
BUCKET_DIGITS = 4
COUNTER_BITS = 33


def digest(key: str, seed: int | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _sum_before(value: str, order: str, partition: Sequence[str] = ()) -> Column:
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def hashed_index(
    df: DataFrame, key: str, seed: int | str, alias: str = "app_index", within: str | None = None
) -> DataFrame:
    """Dense 0-based index of unique keys in a seeded random order, per ``within`` class."""
    mark = F.coalesce(F.col(within).cast("string"), F.lit("\x00")) if within else F.lit("")
    tagged = df.withColumns({"_class": mark, "_digest": digest(key, seed)}).withColumn(
        "_bucket", F.substring("_digest", 1, BUCKET_DIGITS)
    )
    group = ["_class", "_bucket"]
    sizes = tagged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*group, _sum_before("_n", "_bucket", ["_class"]).alias("_offset"))
    if within is None:
        offsets = F.broadcast(offsets)  # at most 16^BUCKET_DIGITS rows
    inside = Window.partitionBy(*group).orderBy("_digest", key)
    placed = tagged.withColumn("_inside", F.row_number().over(inside) - 1)
    index = (F.col("_offset") + F.col("_inside")).cast("bigint")
    return placed.join(offsets, group).select(*df.columns, index.alias(alias))


def _sorted_rows(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Range-sorted rows, written once, with partition number and place inside it."""
    at = F.col("_at")
    rows = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    return rows.withColumns(
        {
            "_part": F.shiftright(at, COUNTER_BITS),
            "_place": at.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1)),
        }
    )


def dense_index(df: DataFrame, order: Sequence[str], alias: str = "app_index") -> DataFrame:
    """Dense 0-based index in the order of ``order``, whose values should be unique."""
    rows = _sorted_rows(df, order, "index")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", _sum_before("_n", "_part").alias("_offset"))
    index = (F.col("_offset") + F.col("_place")).cast("bigint")
    # One offset row per sorted partition.
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, index.alias(alias))


def running_totals(df: DataFrame, order: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Add ``{alias: column}`` sums over all rows strictly before each row in ``order``."""
    rows = _sorted_rows(df, order, "totals")
    per_part = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{a}") for a, c in totals.items()])
    offsets = per_part.select(
        "_part", *[_sum_before(f"_t_{a}", "_part").alias(f"_o_{a}") for a in totals]
    )
    placed = rows.withColumns(
        {f"_i_{a}": _sum_before(c, "_place", ["_part"]) for a, c in totals.items()}
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(F.col(f"_o_{a}") + F.col(f"_i_{a}")).alias(a) for a in totals]
    )


def largest_group(df: DataFrame, key: str) -> int:
    """Row count of the most frequent key, 0 for an empty table."""
    return df.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def slot_positions(df: DataFrame, key: str, order: Sequence[str], alias: str = "slot") -> DataFrame:
    """0-based position of each row among its key's rows in the order of ``order``.

    The table is range-sorted by ``(key, order)``, which splits a large group
    over tasks; each written partition then knows where its part of a key
    starts and how many rows of the key came before.
    """
    rows = _sorted_rows(df, [key, *order], "slots")
    parts = rows.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_k")).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    parts = parts.withColumn("_carried", _sum_before("_n", "_p", ["_k"]))
    # The part number in the join key keeps the large group spread.
    same = (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k"))
    position = F.col("_place") - F.col("_first") + F.col("_carried")
    return rows.join(parts, same).select(*df.columns, position.cast("bigint").alias(alias))


def kfold(df: DataFrame, key: str, folds: int, seed: int | str = 1001, alias: str = "fold") -> DataFrame:
    """Shuffled folds 0..folds-1 whose sizes differ by at most one."""
    indexed = hashed_index(df, key, seed, "_index")
    return indexed.withColumn(alias, F.pmod("_index", F.lit(folds)).cast("int")).drop("_index")


def stratified_kfold(
    df: DataFrame, key: str, target: str, folds: int, seed: int | str = 1001, alias: str = "fold"
) -> DataFrame:
    """Shuffled folds that are balanced inside every target class."""
    indexed = hashed_index(df, key, seed, "_index", within=target)
    return indexed.withColumn(alias, F.pmod("_index", F.lit(folds)).cast("int")).drop("_index")


def roc_auc(scores: DataFrame, label: str, score: str, fold: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half.

    One row for all scores; with ``fold`` also one per fold, and the row for
    all scores has a missing fold. Rows are first merged to one per distinct
    score, so a frequent score is one row; the ranking then runs over distinct
    scores only, for all folds in one pass. All counts are exact.
    """
    by = [F.col(fold).alias("_group")] if fold else []
    merged = scores.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    overall = merged.groupBy("_score").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    if fold:
        merged = merged.unionByName(overall, allowMissingColumns=True)
    else:
        merged = overall.withColumn("_group", F.lit(None).cast("int"))
    ranked = running_totals(merged, ["_group", "_score"], {"_below": "_neg"})
    wide = "decimal(19,0)"
    wins = F.col("_pos").cast(wide) * (F.lit(2) * F.col("_below") + F.col("_neg")).cast(wide)
    parts = ranked.groupBy("_group").agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.sum(wins).alias("_wins"),
        F.min("_below").alias("_base"),
    )
    won = F.col("_wins") - F.lit(2) * F.col("positives").cast(wide) * F.col("_base").cast(wide)
    pairs = F.lit(2.0) * F.col("positives").cast("double") * F.col("negatives").cast("double")
    auc = F.try_divide(won.cast("double"), pairs).alias("auc")
    named = [F.col("_group").alias(fold)] if fold else []
    return parts.select(*named, "positives", "negatives", auc)


def top_groups(df: DataFrame, group: str, value: str, k: int, scale: int = 6) -> DataFrame:
    """All rows of the ``k`` groups with the highest mean value, ties by group name."""
    best = mean_by_group(df, group, value, scale).orderBy(F.desc("mean"), group).limit(k)
    return df.join(best.select(group), group, "left_semi")


def mean_by_group(df: DataFrame, group: str, value: str, scale: int = 6) -> DataFrame:
    rows = df.select(group, fx.to_units(F.col(value), scale).alias("_u"))
    return rows.groupBy(group).agg(F.expr(fx.mean("count(_u)", fx.exact_sum("_u"), scale)).alias("mean"))
