"""Sums, means and variances of units of any size against exact fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from entityloom.operators import moments
from entityloom.plans.compile import aggregate_history
from entityloom.plans.spec import Component, Feature, HistoryFunction
from tests.helpers import one, rows

OPERATIONS = ("count", "sum", "mean", "var", "min", "max")
rng = random.Random(3)
CASES = {
    "cents": ([1.25, 2.5, -3.75], 2),
    "large cents": ([1e17, 3e17], 2),
    "near 2^63": ([8e18, 7e18, 6e18], 0),
    "beyond BIGINT": ([1e300, 5.0, -7.0], 0),
    "cancelling": ([1e17, 12.0, -1e17, 0.5], 1),
    "mixed sizes": ([3e9, -2.5e9, 7.0, 2147483648.0, -2147483649.0], 0),
    "cuts at a limb": ([2.0**31 * k + d for k in (-3, -1, 1, 2) for d in (-1, 0, 1)], 0),
    "near each other": ([1.5e15 + k for k in range(50)], 0),
    "tiny spread of large": ([9.0e15, 9.0e15 - 1, 9.0e15 - 3], 0),
    "random": ([rng.uniform(-1, 1) * 10 ** rng.randint(0, 15) for _ in range(300)], 3),
}


def exact(values, scale):
    units = [Fraction(round(v * 10.0**scale)) if v * 10.0**scale < 2**52 else Fraction(v * 10.0**scale) for v in values]
    n, one_ = len(units), Fraction(10) ** scale
    mean = sum(units) / n
    return sum(units) / one_, mean / one_, sum((u - mean) ** 2 for u in units) / (n - 1) / one_**2


@pytest.fixture(params=[True, False], ids=["ansi", "plain"])
def ansi(request, spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", str(request.param).lower())
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def function(scale, branches=False):
    feature = Feature("x", OPERATIONS, scale=scale)
    parts = [Component("all", "A_", (feature,))]
    parts += [Component(b, f"{b}_", (feature,), branch=("b", b)) for b in "pq"] if branches else []
    wide = [Feature(f"y{i}", ("var", "sum"), scale=0) for i in range(12)] if branches else []
    parts += [Component("wide", "W_", tuple(wide))] if wide else []
    return HistoryFunction("f", "k", tuple(parts))


@pytest.mark.parametrize("name", CASES)
def test_any_size_of_value(spark, ansi, name):
    values, scale = CASES[name]
    df = spark.createDataFrame([(1, v) for v in values], "k int, x double").repartition(3)
    found = one(aggregate_history(df, function(scale)))
    total, mean, var = exact(values, scale)
    assert found["A_x_COUNT"] == len(values)
    assert (found["A_x_MIN"], found["A_x_MAX"]) == pytest.approx((min(values), max(values)), rel=1e-15)
    assert found["A_x_SUM"] == pytest.approx(float(total), rel=4e-16)
    assert found["A_x_MEAN"] == pytest.approx(float(mean), rel=1e-15)
    if float(max(map(abs, values))) < 1e150:
        assert found["A_x_VAR"] == pytest.approx(float(var), rel=1e-12)
    else:
        assert found["A_x_VAR"] is None or found["A_x_VAR"] > 1e300


def test_branches_merge_limbs(spark, ansi):
    values = CASES["mixed sizes"][0] + CASES["near each other"][0]
    lines = [(1, "pqr"[i % 3], v, *[float(i + j) for j in range(12)]) for i, v in enumerate(values)]
    names = ", ".join(f"y{j} double" for j in range(12))
    df = spark.createDataFrame(lines, f"k int, b string, x double, {names}").repartition(3)
    found = one(aggregate_history(df, function(0, True)))
    for branch in "pq":
        total, mean, var = exact([x[2] for x in lines if x[1] == branch], 0)
        got = [found[f"{branch}_x_{o}"] for o in ("SUM", "MEAN", "VAR")]
        assert got == pytest.approx([float(total), float(mean), float(var)], rel=1e-12)
    assert found["W_y3_VAR"] == pytest.approx(float(exact([x[6] for x in lines], 0)[2]))


@pytest.mark.parametrize("kind", ["long", "int"])
def test_whole_columns_stay_exact(spark, ansi, kind):
    big = 2**62 if kind == "long" else 2**31
    values = [big - 1, big - 5, 3, -big]
    df = spark.createDataFrame([(1, v) for v in values], f"k int, x {kind}")
    found = one(aggregate_history(df, function(0)))
    total, mean, var = exact(values, 0)
    assert found["A_x_SUM"] == pytest.approx(float(total), rel=1e-9, abs=2048.0)
    assert found["A_x_VAR"] == pytest.approx(float(var), rel=1e-12)
    assert found["A_x_MEAN"] == pytest.approx(float(mean), rel=1e-9, abs=512.0)


def test_sums_do_not_depend_on_order(spark):
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(0, 17) for _ in range(400)]
    made = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame([(1, v) for v in rng.sample(values, 400)], "k int, x double").repartition(parts)
        made.add(tuple(one(aggregate_history(df, function(2)))[f"A_x_{o}"] for o in ("SUM", "MEAN")))
    assert len(made) == 1


def test_kernels_take_any_size(spark, ansi):
    values = [4e9, -3e9, 2.5, 1e16]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, x double")
    found = one(moments.masked_moments(df, "k", F.col("x"), F.lit(1.0), 1))
    assert found["sum"] == pytest.approx(sum(values), rel=4e-16)
    assert found["sum_squares"] == pytest.approx(sum(v * v for v in values))
    dot = rows(moments.chunked_dot_product(df, "k", "i", F.col("x"), F.lit(2.0), 2, 1))
    assert dot == [{"k": 1, "chunks": 2, "dot": pytest.approx(2 * sum(values), rel=4e-16)}]
