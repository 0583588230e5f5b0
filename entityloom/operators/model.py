"""Fold-wise training and scoring on a feature table.

The learner is histogram boosting of all folds at once (``boosting``). A fold
ends when its held-out AUC has not risen for ``PATIENCE`` trees and keeps the
trees up to its best, as the original learner does. A missing value is a branch
of its own in every split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from entityloom.operators import boosting
from entityloom.operators.ordering import kfold, stratified_kfold
from entityloom.operators.stage import content_fingerprint, load_stage, read_completion, write_stage
from entityloom.session import materialise, share_package

# The original learner's parameters, and its library's default of
# the least rows in a leaf. It names a share of rows per tree as well, but never
# turns row sampling on.
TREES = 10_000
LEAVES = 34
DEPTH = 8
STEP = 0.02
FEATURE_SHARE = 0.9497036
L1 = 0.041545473
L2 = 0.0735294
LEAST_GAIN = 0.0222415
LEAST_WEIGHT = 39.3259775
LEAST_ROWS = 20
PATIENCE = 200
# Fixed value: the library's default of the least weight in a leaf, for tables so
# small that the original's value would allow no split at all.
SMALL_LEAST_WEIGHT = 1e-3


@dataclass(frozen=True)
class FoldResult:
    """Out-of-fold scores, mean scores of unlabelled rows, importances per fold.

    ``trees`` holds the models as a table.
    """

    out_of_fold: DataFrame
    scores: DataFrame
    importance: DataFrame
    trees: DataFrame | None = None


def train_folds(
    df: DataFrame,
    key: str,
    target: str,
    features: Sequence[str],
    folds: int = 10,
    seed: int = 1001,
    stratified: bool = False,
    trees: int = TREES,
    depth: int = DEPTH,
    step: float = STEP,
    feature_share: float = FEATURE_SHARE,
    patience: int = PATIENCE,
    leaves: int = LEAVES,
    l1: float = L1,
    l2: float = L2,
    least_gain: float = LEAST_GAIN,
    least_weight: float = SMALL_LEAST_WEIGHT,
    least_rows: int = LEAST_ROWS,
    stages: str | None = None,
) -> FoldResult:
    """Train one classifier per fold on the other folds.

    ``trees`` is an upper bound: a fold stops when ``patience`` trees have not
    raised the AUC of its held-out rows, and keeps those up to the highest.
    Every labelled row gets one score, from the model that has not seen it;
    every unlabelled row gets the mean of all models' scores, in one pass over
    these rows. Importance is a feature's share of a model's splits.

    With ``stages`` the models are kept below that folder as a stage named by the
    content of the table and the parameters; the same training is then loaded.
    """
    spark = df.sparkSession
    share_package(spark)
    rules = boosting.Rules(
        trees, leaves, depth, step, patience, feature_share, l1, l2, least_gain, least_weight, least_rows, seed
    )
    numbers = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    names = [f"f{i}" for i in range(len(features))]
    # Written once: bounds, bins and folds read the same rows without the feature plan.
    ready = materialise(
        df.select(F.col(f"`{key}`").alias(key), F.col(f"`{target}`").cast("double").alias("label"), *numbers), "rows"
    )
    known = ready.filter(F.col("label").isNotNull())
    bounds = boosting.quantile_bounds(known, names)
    binned = boosting.with_bins(ready, names, bounds)
    labelled = binned.filter(F.col("label").isNotNull())
    foldwise = (
        stratified_kfold(labelled, key, "label", folds, seed)
        if stratified
        else kfold(labelled, key, folds, seed)
    )
    labelled = materialise(foldwise, "labelled")

    def fitted() -> DataFrame:
        models = boosting.boost(labelled, len(features), folds, rules)
        return spark.createDataFrame(boosting.as_table(models), boosting.TREES).coalesce(1)

    if stages is None:
        kept = materialise(fitted(), "trees")
    else:
        named = repr((tuple(content_fingerprint(ready)), key, target, tuple(features), folds, stratified, rules))
        path = f"{stages}/folds-{hashlib.sha256(named.encode()).hexdigest()[:32]}"
        complete = read_completion(spark, path) is not None
        kept = load_stage(spark, path) if complete else write_stage(fitted(), path, "folds")
    forests = boosting.forests(kept.toArrow())  # at most ``folds`` times ``trees`` times twice ``leaves`` nodes

    out_of_fold = boosting.scored(labelled.select(key, "label", "fold", "bins"), forests, own=True)
    unlabelled = binned.filter(F.col("label").isNull()).select(key, "bins")
    importance = split_shares(forests, features)
    table = spark.createDataFrame(importance, "feature string, importance double, fold int")
    return FoldResult(out_of_fold, boosting.scored(unlabelled, forests, own=False), table, kept)


def split_shares(forests: Mapping[int, boosting.Forest], features: Sequence[str]) -> list[tuple]:
    """(feature, share of the model's splits, fold from 1); 0 for a model without splits."""
    out = []
    for fold, forest in forests.items():
        split_on = forest.nodes[0]
        counts = np.bincount(split_on[split_on >= 0], minlength=len(features)).tolist()
        total = max(sum(counts), 1)
        out += [(name, n / total, fold + 1) for name, n in zip(features, counts, strict=True)]
    return out


def mean_of(columns: Sequence[str]) -> Column:
    """Mean of score columns of one row, added up in the order given."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / F.lit(float(len(columns)))


def total_importance(importance: DataFrame, digits: int = 6) -> DataFrame:
    """Features and summed importance per fold; a model that split at all has 1."""
    return importance.groupBy("fold").agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), digits).alias("importance")
    )
