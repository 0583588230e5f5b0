"""Histogram boosting against a plain learner that tries every split row by row."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityloom.operators import boosting, model, ordering
from tests.helpers import rows

RULES = boosting.Rules(
    trees=4, leaves=6, depth=4, step=0.3, patience=50, feature_share=1.0,
    l1=0.04, l2=0.07, least_gain=0.02, least_weight=0.5, least_rows=5, seed=3,
)


def table(n=200, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 12, n).astype(float)
    b = rng.normal(size=n).round(1)
    c = rng.integers(0, 2, n).astype(float)
    a[rng.random(n) < 0.2] = np.nan
    chance = 1 / (1 + np.exp(-(np.where(np.isnan(a), 2.0, a / 4 - 1.5) + b * c)))
    return np.column_stack([a, b, c]), (rng.random(n) < chance).astype(float), np.arange(n) % 3


def frame(spark, x, y, fold, parts=3):
    lines = [
        (i, float(y[i]), int(fold[i]), *[None if math.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))
    ]
    df = spark.createDataFrame(lines, "id long, label double, fold int, f0 double, f1 double, f2 double")
    names = ["f0", "f1", "f2"]
    return boosting.with_bins(df.repartition(parts), names, boosting.quantile_bounds(df, names))


def term(g, h, rules):
    return max(abs(g) - rules.l1, 0.0) ** 2 / (h + rules.l2)


def plain_split(x, g, h, inside, rules):
    """Best (gain, feature, bound, missing left, left rows) over every bound of every feature."""
    best = None
    whole = term(g[inside].sum(), h[inside].sum(), rules)
    for feature in range(x.shape[1]):
        for missing_left in (False, True):
            for bound in sorted({v for v in x[inside, feature] if not math.isnan(v)}):
                left = np.array([missing_left if math.isnan(v) else v <= bound for v in x[inside, feature]])
                sides = inside[left], inside[~left]
                if min(map(len, sides)) < rules.least_rows or min(h[s].sum() for s in sides) < rules.least_weight:
                    continue
                gain = sum(term(g[s].sum(), h[s].sum(), rules) for s in sides) - whole
                if gain > rules.least_gain and (best is None or gain > best[0] + 1e-9):
                    best = (gain, feature, bound, missing_left, sides)
    return best


def plain_margins(x, y, own, fold, rules):
    """Margins of all rows after each tree of one fold."""
    train = np.flatnonzero(own != fold)
    margin = np.full(len(y), math.log(y[train].mean() / (1 - y[train].mean())))
    out = []
    for _ in range(rules.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * boosting.UNIT) / boosting.UNIT for v in (p - y, p * (1 - p)))
        leaves = [(train, np.arange(len(y)), 0)]
        while len(leaves) < rules.leaves:
            found = [
                (s[0], i, s) for i, (t, _, d) in enumerate(leaves)
                if d < rules.depth and (s := plain_split(x, g, h, t, rules))
            ]
            if not found:
                break
            _, i, (_, feature, bound, missing_left, _) = max(found, key=lambda f: (f[0], -f[1]))
            t, every, d = leaves.pop(i)
            for side in (True, False):
                part = [
                    s[np.array([(missing_left if math.isnan(v) else v <= bound) == side for v in x[s, feature]], dtype=bool)]
                    for s in (t, every)
                ]
                leaves.append((*part, d + 1))
        for t, every, _ in leaves:
            total = g[t].sum()
            margin[every] -= np.sign(total) * max(abs(total) - rules.l1, 0) / (h[t].sum() + rules.l2) * rules.step
        out.append(margin.copy())
    return out


@pytest.mark.parametrize(("parts", "local"), [(1, 4096), (4, 4096), (4, 40), (4, 0), (1, 0)])
def test_trees_equal_a_plain_learner(spark, parts, local, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 3)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", local)
    x, y, own = table()
    data = frame(spark, x, y, own, parts)
    bins = {r.id: np.frombuffer(r.bins, np.uint8) for r in data.select("id", "bins").collect()}
    bins = np.array([bins[i] for i in range(len(y))]).T
    models = boosting.boost(data, 3, 3, replace(RULES, patience=1000))
    assert [m.fold for m in models] == [0, 1, 2]
    for m in models:
        expected = plain_margins(x, y, own, m.fold, RULES)
        assert 0 < len(m.trees) <= RULES.trees
        margin = m.margin + boosting._applied([t.arrays() for t in m.trees], bins)
        assert margin == pytest.approx(expected[len(m.trees) - 1], abs=1e-9)
        for tree in m.trees:
            assert tree.splits() <= RULES.leaves - 1
        # The trees kept are those up to the best AUC of the held-out rows.
        held = own == m.fold
        aucs = []
        for e in expected:
            ones, zeros = e[held & (y == 1)], e[held & (y == 0)]
            aucs.append(np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]))
        assert aucs[len(m.trees) - 1] == pytest.approx(max(aucs), abs=2e-3)


def test_trees_do_not_depend_on_partitions(spark):
    x, y, own = table(150, 1)
    made = [boosting.as_rows(boosting.boost(frame(spark, x, y, own, n), 3, 3, RULES)) for n in (1, 2, 7)]
    assert made[0] == made[1] == made[2]


def test_models_survive_as_rows(spark):
    x, y, own = table(120, 2)
    models = boosting.boost(frame(spark, x, y, own), 3, 3, RULES)
    models.append(boosting.Model(3, 0.25, []))
    stored = rows(spark.createDataFrame(boosting.as_rows(models), boosting.TREES).repartition(4))
    assert boosting.from_rows(stored) == models


def test_missing_values_take_the_side_that_gains(spark):
    df = spark.range(300).select(
        "id",
        F.when(F.col("id") < 240, (F.col("id") % 3 == 0).cast("int")).alias("y"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 7).cast("double")).alias("a"),
        F.lit(None).cast("double").alias("none"),
    )
    result = model.train_folds(df, "id", "y", ["a", "none"], folds=3, trees=3)
    assert {r["auc"] for r in rows(ordering.roc_auc(result.out_of_fold, "label", "score", "fold").dropna())} == {1.0}
    shares = rows(result.importance, "fold", "feature")
    assert [r["importance"] for r in shares] == [1.0, 0.0] * 3
    high = {r["id"] % 3 == 0: r["score"] for r in rows(result.scores)}
    assert high[True] > high[False]


def test_folds_wait_for_a_gain():
    fold = boosting._Fold(0, 0.0, 0.0, 0.0)
    for auc, ended in ((0.5, False), (0.6, False), (0.6, False), (0.59, False), (0.55, True)):
        fold.trees.append(boosting.Tree())
        fold.judge(auc, 3)
        assert fold.ended == ended
    assert fold.best == 2


def test_auc_counts():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 4, (2, 30))
    zeros, ones = (np.repeat(np.arange(30), c) for c in counts)
    wins = [(a > b) + 0.5 * (a == b) for a in ones for b in zeros]
    assert boosting.auc_of(counts) == pytest.approx(np.mean(wins))
    assert boosting.auc_of(np.array([[3, 1], [0, 0]])) == 0.5


def test_tables_without_a_split_or_a_class(spark):
    df = spark.range(30).select("id", (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("a"))
    result = model.train_folds(df, "id", "y", ["a"], folds=2)
    scored = rows(result.out_of_fold)
    for r in scored:  # the share of ones that its model has seen
        seen = [x["label"] for x in scored if x["fold"] != r["fold"]]
        assert r["score"] == pytest.approx(sum(seen) / len(seen))
    assert {r["importance"] for r in rows(result.importance)} == {0.0}
    same = model.train_folds(df.withColumn("y", F.lit(1)), "id", "y", ["a"], folds=2)
    assert all(r["score"] > 0.99 for r in rows(same.out_of_fold))


def test_wide_tables_grow_fewer_folds_at_once(spark, monkeypatch):
    x, y, own = table(90, 4)
    data = frame(spark, x, y, own)
    rules = replace(RULES, trees=2)
    whole = boosting.as_rows(boosting.boost(data, 3, 3, rules))
    monkeypatch.setattr(boosting, "TASK_BYTES", 1)
    assert boosting.as_rows(boosting.boost(data, 3, 3, rules)) == whole


def test_a_trained_stage_is_loaded_again(spark, tmp_path, monkeypatch):
    df = spark.range(80).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 4).cast("double").alias("a"))
    train = lambda d: model.train_folds(d, "id", "y", ["a"], folds=2, trees=2, stages=str(tmp_path))
    first = rows(train(df).out_of_fold, "id")
    monkeypatch.setattr(boosting, "boost", lambda *a: pytest.fail("trained again"))
    assert rows(train(df).out_of_fold, "id") == first
    with pytest.raises(pytest.fail.Exception, match="trained again"):
        train(df.withColumn("a", F.col("a") + 1))


@pytest.mark.parametrize(("parts", "local"), [(1, 4096), (4, 4096), (4, 40), (4, 0), (1, 0)])
def test_folds_grown_whole_equal_folds_grown_by_levels(spark, parts, local, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 3)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", local)
    x, y, own = table(260, 5)
    data = frame(spark, x, y, own, parts)
    rules = replace(RULES, trees=8, feature_share=0.7)
    whole = boosting.as_rows(boosting.boost(data, 3, 3, rules))
    monkeypatch.setattr(boosting, "FOLD_BYTES", 0)
    assert boosting.as_rows(boosting.boost(data, 3, 3, rules)) == whole


def test_small_tables_are_trained_without_a_job_for_each_tree(spark):
    x, y, own = table(200, 6)
    data = frame(spark, x, y, own)
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        models = boosting.boost(data, 3, 3, replace(RULES, trees=40, patience=1000))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [m.fold for m in models] == [0, 1, 2]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) < 10


def test_histograms_of_features_of_any_width(monkeypatch):
    rng = np.random.default_rng(8)
    bins = np.array([rng.integers(0, n, 500) for n in (1, 2, 255, 7, 40)]).astype(np.uint8)
    label = rng.integers(0, 2, 500).astype(np.uint8)
    sums = boosting._gradients(rng.normal(size=500), label)
    rules = replace(RULES, leaves=20, depth=6, least_rows=3, least_weight=0.01)
    one = boosting._grown([0, 1, 2, 3, 4], 0, bins, np.arange(500), *sums, rules).finished(rules)
    assert one.splits() > 5
    monkeypatch.setattr(boosting, "CALL_CELLS", 1)
    assert boosting._grown([0, 1, 2, 3, 4], 0, bins, np.arange(500), *sums, rules).finished(rules) == one


@pytest.mark.parametrize("local", [4096, 40, 0])
def test_equal_rows_are_one_line_of_their_weight(spark, local, monkeypatch):
    monkeypatch.setattr(boosting, "LOCAL_ROWS", local)
    x, y, own = table(120, 9)
    x, y, own = np.tile(x, (3, 1)), np.tile(y, 3), np.tile(own, 3)
    data = frame(spark, x, y, own, 4)
    lines = rows(boosting.merged_lines(data))
    assert sum(r["n"] for r in lines) == len(y) and len(lines) <= len(y) / 3
    rules = replace(RULES, patience=1000)
    whole = boosting.boost(data, 3, 3, rules)
    bins = {r.id: np.frombuffer(r.bins, np.uint8) for r in data.select("id", "bins").collect()}
    bins = np.array([bins[i] for i in range(len(y))]).T
    for m in whole:
        margin = m.margin + boosting._applied([t.arrays() for t in m.trees], bins)
        assert margin == pytest.approx(plain_margins(x, y, own, m.fold, RULES)[len(m.trees) - 1], abs=1e-9)
    monkeypatch.setattr(boosting, "FOLD_BYTES", 0)
    assert boosting.as_rows(boosting.boost(data, 3, 3, rules)) == boosting.as_rows(whole)


def test_many_equal_rows_are_trained_without_a_job_for_each_tree(spark, monkeypatch):
    x, y, own = table(150, 10)
    data = frame(spark, np.tile(x, (4, 1)), np.tile(y, 4), np.tile(own, 4))
    monkeypatch.setattr(boosting, "FOLD_BYTES", 3 * len(y))  # the lines' bins, but not the rows'
    spark.sparkContext.setJobGroup("equal rows", "")
    try:
        boosting.boost(data, 3, 3, replace(RULES, trees=40, patience=1000))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("equal rows")) < 12


def test_forests_hold_the_trees_of_their_rows(spark):
    x, y, own = table(120, 11)
    models = [*boosting.boost(frame(spark, x, y, own), 3, 3, RULES), boosting.Model(3, 0.25, [])]
    stored = spark.createDataFrame(boosting.as_table(models), boosting.TREES).repartition(4)
    found = boosting.forests(stored.toArrow())
    for m in models:
        trees = found[m.fold].trees()
        assert found[m.fold].margin == m.margin and len(trees) == len(m.trees)
        for tree, kept in zip(m.trees, trees, strict=True):
            assert [a.tolist() for a in tree.arrays()] == [a.tolist() for a in kept]


def test_every_different_line_is_scored_once(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 5).cast("double").alias("a"))
    df = df.withColumn("y", F.when(F.col("id") < 300, F.col("y")))
    result = model.train_folds(df, "id", "y", ["a"], folds=2, trees=2, patience=5)
    for scores, n in ((result.out_of_fold, 300), (result.scores, 100)):
        assert scores.count() == n
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and plan.index("MapInArrow") < plan.index("Aggregate")  # distinct lines come first
