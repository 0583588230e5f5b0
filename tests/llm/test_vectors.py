"""Hard negatives and top-k search against brute force over Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityloom.llm import blocks, negatives, topk
from entityloom.llm.workers import share_path

SCHEMA = (
    "vec_id long, vec array<double>, label int, id long, asks boolean, v string, _row long, least double, norm string"
)


def vectors(spark, rows):
    """Vectors beside columns whose names the operators use themselves."""
    share_path(spark)
    return spark.createDataFrame([(i, v, lab, -1, True, "v", 7, 0.0, "n") for i, v, lab in rows], SCHEMA).repartition(3)


def whole(v, factor):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(x * factor) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))  # noqa: B905 - a shorter vector ends with zeros


def tie(i):
    return (i is None, i or 0)


def brute_top(rows, asks, factor, k):
    usable = [(i, w) for i, v, _ in rows if (w := whole(v, factor)) is not None]
    out = []
    for q, a in usable:
        if q is not None and asks(q):
            scored = sorted((-dot(a, b), tie(i), i) for i, b in usable if i is None or i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(scored)]
    return out


def brute_negatives(rows, anchors, factor, positives=5, n=3):
    usable = [(i, w, lab) for i, v, lab in rows if lab is not None and (w := whole(v, factor)) is not None]
    out = []
    for q, a, lab in usable:
        if q is None or not anchors(q):
            continue
        scored = sorted((-dot(a, b), tie(i), i, lab == x) for i, b, x in usable if i is None or i != q)
        for s, _, p, _ in [x for x in scored if x[3]][:positives]:
            hits = [x for x in scored if not x[3] and 50 * -s <= 100 * -x[0] <= 95 * -s][:n]
            out += [(q, p, r + 1, x[2], -s, -x[0]) for r, x in enumerate(hits)]
    return out


def edge_rows(seed=5, n=300):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).round(2).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows[3] = (3, None, 1)
    rows[4] = (4, [1.0, None, 2.0], 1)
    rows[5] = (5, [1.0, float("nan")], 1)
    rows[6] = (6, [float("inf")], 1)
    rows[10] = (10, [], 2)
    rows[20] = (20, [0.0] * 8, 2)
    rows[30] = (30, [2.0, 1.0], 3)  # shorter
    rows[40] = (40, rows[41][1], 1)  # ties
    rows[50] = (50, rows[41][1], None)
    rows += [(41, rows[41][1], 1)] * 3 + [(60, rows[60][1], rows[60][2])]  # repeated rows
    rows += [(None, rows[41][1], 1), (None, rows[42][1], 2), (2**53 + 10, rows[43][1], 1), (-20, rows[44][1], 0)]
    rows += [(900, rng.normal(size=8).tolist(), 9)]  # the only row of its label
    rows += [(1000 + i, rows[45][1], 0) for i in range(40)]  # a large group of copies
    return rows


def test_top_k(spark):
    rows = edge_rows()
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, "vec_id", "vec", 10.0, 7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    expected = brute_top(rows, lambda q: q % 20 == 0, 10.0, 7)
    key = lambda r: (r[0], r[1], tie(r[2]), r[3])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_top_k_of_few_rows_and_none(spark):
    rows = [(0, [1.0], 1), (20, [-2.0], 1), (1, [3.0], 1)]
    search = lambda r: topk.search(vectors(spark, r), F.col("vec_id") % 20 == 0, "vec_id", "vec", 1.0, 5)
    assert sorted(map(tuple, search(rows).collect())) == sorted(brute_top(rows, lambda q: q % 20 == 0, 1.0, 5))
    assert search([]).count() == 0
    assert search([(0, [1.0], 1)]).count() == 0
    assert search([(1, [1.0], 1)]).count() == 0


@pytest.mark.parametrize("factor", [1e3, 1e9, 1e16])
def test_top_k_stays_exact_for_large_values(spark, factor):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-9, 9, 5) / 8).tolist(), 0) for i in range(30)]
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, "vec_id", "vec", min(factor, 5e8), 4)
    expected = brute_top(rows, lambda q: q % 10 == 0, min(factor, 5e8), 4)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 37)
    rows = edge_rows(6)
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 4 == 0, "vec_id", "vec", 10.0, 3)
    key = lambda r: (r[0], r[1], tie(r[2]), r[3])
    expected = brute_top(rows, lambda q: q % 4 == 0, 10.0, 3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    mined = negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, "vec_id", F.col("label"), "vec", 10.0)
    assert sorted(map(repr, map(tuple, mined.collect()))) == sorted(
        map(repr, brute_negatives(rows, lambda q: q % 10 == 0, 10.0))
    )


@pytest.mark.parametrize("factor", [10.0, 1e12])
def test_hard_negatives(spark, factor):
    rows = edge_rows() if factor == 10.0 else [(i, [x / 4e3 for x in v], lab) for i, v, lab in edge_rows(n=80)[70:80]]
    got = negatives.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0, "vec_id", F.col("label"), "vec", factor)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute_negatives(rows, lambda q: q % 5 == 0, factor)
    assert len(expected) > 1
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_hard_negatives_of_few_rows_and_none(spark):
    def mine(rows):
        anchors = F.col("vec_id") % 50 == 0
        return negatives.mine(vectors(spark, rows), anchors, "vec_id", F.col("label"), "vec").collect()

    assert mine([]) == []
    assert mine([(0, [1.0], 1)]) == []
    assert mine([(0, [1.0], 1), (1, [4.0], 1), (2, [-3.0], 2)]) == []
    assert mine([(0, [1.0], 1), (1, [-4.0], 1), (2, [-3.0], 2)]) == []  # a negative positive score has no window
    assert [tuple(r) for r in mine([(0, [1.0], 1), (1, [4.0], 1), (2, [3.0], 2)])] == [(0, 1, 1, 2, 4, 3)]


def test_threshold_scores_lose_no_pair():
    rng = np.random.default_rng(1)
    anchors, rows = (np.floor(64 * rng.normal(size=(n, 40))) for n in (30, 200))
    rows[:, 7] *= 9  # one heavy dimension
    rows[5] = 0
    anchors[3] = 0
    scores = anchors @ rows.T
    for share in (-np.inf, -0.5, 0.0, 0.2, 0.6, 0.99, 2.0):
        least = np.full(30, share if share == -np.inf else share * scores.max())
        a, r, s = negatives.threshold_scores(anchors.astype(np.float32), rows.astype(np.float32), least)
        expected = {(i, j): scores[i, j] for i, j in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
        assert {(i, j): x for i, j, x in zip(a, r, s, strict=True)} == expected


@pytest.mark.parametrize("share", [0.2, 0.35, 0.5, 0.8])
def test_few_pairs_are_multiplied_one_by_one(monkeypatch, share):
    """Norms of random vectors prune little: what is left of many pairs is one matrix product."""
    rng = np.random.default_rng(6)
    anchors, rows = (rng.normal(size=(n, 64)) for n in (50, 400))
    anchors, rows = (np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)) for x in (anchors, rows))
    single, einsum = [], np.einsum
    monkeypatch.setattr(negatives.np, "einsum", lambda form, a, b: single.append(len(a)) or einsum(form, a, b))
    least = share * (anchors**2).sum(axis=1)
    a, r, s = negatives.threshold_scores(anchors.astype(np.float32), rows.astype(np.float32), least)
    scores = anchors @ rows.T
    expected = {(i, j): scores[i, j] for i, j in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
    assert {(i, j): x for i, j, x in zip(a, r, s, strict=True)} == expected
    assert sum(single) <= scores.size / 100


def test_postings_scatter_equals_products():
    rng = np.random.default_rng(4)
    left, right = (rng.integers(-5, 6, (n, 30)) * (rng.random((n, 30)) < 0.3) for n in (17, 40))
    right[:, 4] = 3  # one dimension that every row has
    cells = [(*np.nonzero(x), x[np.nonzero(x)].astype(float)) for x in (left, right)]
    lists = [topk.postings(*c, n) for c, n in zip(cells, (17, 40), strict=True)]
    assert (topk.scatter(*lists, 17, 40, np.dtype(float)) == left @ right.T).all()
