"""Scalar rules, kernels and fixed-point statistics."""

import statistics
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from entityloom.functions import arrays, scalars
from entityloom.operators import moments
from entityloom.plans.compile import aggregate_history
from entityloom.plans.spec import CategoryShare, Component, Feature, HistoryFunction
from tests.helpers import one, rows


def evaluate(spark, make, *values, types="double"):
    columns = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{c} {types}" for c in columns))
    return df.select(make(*[F.col(c) for c in columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("12.5", 12.5),
        (" 3 ", 3.0),
        ("\t-1e2\n", -100.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("", None),
        ("   ", None),
        ("abc", None),
        ("inf", None),
        ("nan", None),
        ("1d", None),
        ("0x10", None),
        ("1e999", None),
        (None, None),
    ],
)
def test_parse_number(spark, text, expected):
    assert evaluate(spark, scalars.parse_number, text, types="string") == expected


@pytest.mark.parametrize("text, expected", [(" a ", "a"), ("\t\n", None), ("", None), (None, None)])
def test_normalise_key(spark, text, expected):
    assert evaluate(spark, scalars.normalise_key, text, types="string") == expected


def test_ratio_and_difference_rules(spark):
    assert evaluate(spark, scalars.ratio, 1.0, 0.0) is None
    assert evaluate(spark, scalars.ratio, 0.0, 0.0) is None
    assert evaluate(spark, scalars.ratio, 1.0, -0.0) is None
    assert evaluate(spark, scalars.ratio, float("inf"), 2.0) is None
    assert evaluate(spark, scalars.ratio, 3.0, 2.0) == 1.5
    zero = lambda a, b: scalars.positive_difference(a, b, "zero")
    drop = lambda a, b: scalars.positive_difference(a, b, "drop")
    assert evaluate(spark, zero, None, 1.0) == 0.0
    assert evaluate(spark, drop, None, 1.0) is None
    assert evaluate(spark, zero, 5.0, 1.0) == evaluate(spark, drop, 5.0, 1.0) == 4.0
    assert evaluate(spark, drop, 1.0, 5.0) == 0.0


def test_sentinel_branch_and_inequality(spark):
    assert evaluate(spark, lambda a: scalars.sentinel_to_null(a, 365243), 365243.0) is None
    assert evaluate(spark, lambda a: scalars.sentinel_to_null(a, 365243), 1.0) == 1.0
    assert evaluate(spark, lambda a: scalars.differs_or_missing(a, "XNA"), None, types="string") is True
    assert evaluate(spark, lambda a: scalars.branch_mask(a, "x"), None, types="string") == 0.0
    assert evaluate(spark, lambda a: scalars.branch_mask(a, "x"), "x", types="string") == 1.0


def test_scores(spark):
    score = lambda *c: scalars.linear_score(c, (1.0, 2.0), 0.5)
    assert evaluate(spark, score, 1.0, 1.0) == 3.5
    assert evaluate(spark, lambda x: scalars.polynomial_score(x, (1.0, 0.5, 3.0)), 0.5) == 2.0
    with pytest.raises(ValueError):
        scalars.polynomial_score(F.lit(1.0), (1.0,))
    with pytest.raises(ValueError):
        scalars.linear_score([F.lit(1.0)], (1.0, 2.0))


VALUES, MASK = [1.0, -2.0, 3.0, 99.0], [1.0, 1.0, 1.0, 0.0]


def test_array_kernels(spark):
    df = spark.createDataFrame([(VALUES, [0.0] * 4, MASK)], "v array<double>, z array<double>, m array<double>")
    got = one(
        df.select(
            arrays.moments(F.col("v"), F.col("m")).alias("k"),
            arrays.difference_moments(F.col("v"), F.col("z"), F.col("m")).alias("d"),
            arrays.dot(F.col("v"), F.col("m")).alias("dot"),
        )
    )
    assert tuple(got["k"]) == tuple(got["d"]) == (3.0, 2.0, 14.0)
    assert got["dot"] == 2.0


@pytest.mark.parametrize("other", [[1.0], []])
def test_array_kernels_reject_bad_shapes(spark, other):
    left = VALUES if other else []
    df = spark.createDataFrame([(left, other)], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="vectors must"):
        df.select(arrays.dot(F.col("a"), F.col("b"))).collect()


def test_row_and_array_moments_agree(spark):
    cells = spark.createDataFrame([("k", v, m) for v, m in zip(VALUES, MASK)], "k string, v double, m double")
    exact = one(moments.masked_moments(cells, "k", F.col("v"), F.col("m"), 2))
    plain = one(moments.masked_moments(cells, "k", F.col("v"), F.col("m")))
    assert exact == plain == {"k": "k", "count": 3.0, "sum": 2.0, "sum_squares": 14.0}
    final = one(moments.finalise(spark.createDataFrame([plain]), "count", "sum", "sum_squares"))
    assert final["mean"] == pytest.approx(2 / 3) and final["var"] == pytest.approx(19 / 3)


def test_chunked_dot_product_equals_the_whole(spark):
    cells = spark.createDataFrame([("k", i, i * 0.5, 2.0) for i in range(25)], "k string, p int, l double, r double")
    whole = one(moments.dot_product(cells, "k", F.col("l"), F.col("r"), 2))
    for size in (1, 7, 25, 100):
        part = one(moments.chunked_dot_product(cells, "k", "p", F.col("l"), F.col("r"), size, 2))
        assert part["dot"] == whole["dot"] == 300.0
        assert part["chunks"] == -(-25 // size)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_values_stay_exact(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        keys = [20_000_000_000 + i for i in range(4)] + [7]
        df = spark.createDataFrame([("k", v, v / 1e7) for v in keys], "k string, v long, r double")
        whole = Feature("v", ("sum", "mean", "var"), scale=0)
        ratio = Feature("r", ("var",), scale=6)
        got = one(aggregate_history(df, HistoryFunction("f", "k", (Component("all", "A_", (whole, ratio)),))))
        assert got["A_v_SUM"] == float(sum(keys))
        assert got["A_v_VAR"] == pytest.approx(statistics.variance(keys), rel=1e-15)
        assert got["A_r_VAR"] == pytest.approx(statistics.variance(k / 1e7 for k in keys), rel=1e-9)
        huge = spark.createDataFrame([("k", 9e18, 1.0)] * 2, "k string, l double, r double")
        assert one(moments.dot_product(huge, "k", F.col("l"), F.col("r"), 0))["dot"] == 1.8e19
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


amounts = st.lists(
    st.one_of(st.none(), st.integers(-10**9, 10**9).map(lambda i: i / 100)), min_size=1, max_size=30
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=amounts, seed=st.integers(0, 5))
def test_exact_statistics_match_python(spark, values, seed):
    data = [("k", v, "ab"[(i * 7 + seed) % 2]) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k string, v double, b string").repartition(3)
    feature = Feature("v", ("count", "sum", "mean", "var", "min", "max", "size"), scale=2)
    function = HistoryFunction(
        "f", "k", (Component("all", "ALL_", (feature,)), Component("a", "A_", (feature,), branch=("b", "a")))
    )
    got = one(aggregate_history(df, function))
    for prefix, chosen in (("ALL_", data), ("A_", [r for r in data if r[2] == "a"])):
        present = [Decimal(str(r[1])) for r in chosen if r[1] is not None]
        if not chosen:
            assert got[f"{prefix}v_SUM"] is None and got[f"{prefix}v_SIZE"] is None
            continue
        assert got[f"{prefix}v_SIZE"] == len(chosen)
        assert got[f"{prefix}v_COUNT"] == len(present)
        assert got[f"{prefix}v_SUM"] == float(sum(present))
        assert got[f"{prefix}v_MIN"] == (float(min(present)) if present else None)
        assert got[f"{prefix}v_MAX"] == (float(max(present)) if present else None)
        expected = float(statistics.variance(present)) if len(present) > 1 else None
        assert got[f"{prefix}v_VAR"] == (pytest.approx(expected, rel=1e-12) if expected is not None else None)


def test_plain_and_exact_statistics_agree(spark):
    data = [(f"k{i % 3}", i * 1.25 - 7, "xyz"[i % 3 == 0]) for i in range(40)]
    df = spark.createDataFrame(data, "k string, v double, b string")

    def run(scale):
        feature = Feature("v", ("sum", "mean", "var", "min", "max"), scale=scale)
        parts = (Component("all", "", (feature,)), Component("x", "X_", (feature,), branch=("b", "x")))
        return rows(aggregate_history(df, HistoryFunction("f", "k", parts)), "k")

    for exact, plain in zip(run(2), run(None)):
        assert exact == pytest.approx(plain)


def test_large_squares_at_any_scale(spark):
    """Values that an earlier version refused at the finer scale."""
    df = spark.createDataFrame([("k", 1e9), ("k", 2e9)], "k string, v double")
    for scale in (0, 4, 6):
        function = HistoryFunction("f", "k", (Component("all", "", (Feature("v", ("var",), scale=scale),)),))
        assert one(aggregate_history(df, function))["v_VAR"] == pytest.approx(5e17)


def test_group_of_missing_values(spark):
    df = spark.createDataFrame([("k", None, None), ("k", None, None)], "k string, v double, c string")
    ops = ("count", "sum", "mean", "var", "min", "nunique", "size")
    for scale in (None, 2):
        function = HistoryFunction(
            "f", "k", (Component("all", "", (Feature("v", ops, scale=scale),)),), (CategoryShare("c", ("a",)),)
        )
        assert one(aggregate_history(df, function)) == {
            "k": "k",
            "v_COUNT": 0,
            "v_SUM": 0.0,
            "v_MEAN": None,
            "v_VAR": None,
            "v_MIN": None,
            "v_NUNIQUE": 0,
            "v_SIZE": 2,
            "c_a_MEAN": 0.0,
            "c_nan_MEAN": 1.0,
        }


def test_rows_without_key_belong_to_no_group(spark):
    df = spark.createDataFrame([(None, 1.0), ("k", 2.0)], "k string, v double")
    function = HistoryFunction("f", "k", (Component("all", "", (Feature("v", ("sum",)),)),))
    assert one(aggregate_history(df, function)) == {"k": "k", "v_SUM": 2.0}


def test_text_columns_are_parsed(spark):
    df = spark.createDataFrame([("k", " 1.5 "), ("k", "bad"), ("k", "2")], "k string, v string")
    function = HistoryFunction("f", "k", (Component("all", "", (Feature("v", ("sum", "count")),)),))
    assert one(aggregate_history(df, function)) == {"k": "k", "v_SUM": 3.5, "v_COUNT": 2}


def test_wide_functions_are_cut_into_parts(spark):
    names = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame([("k", *range(40)), ("k", *range(1, 41))], "k string, " + ", ".join(f"{n} int" for n in names))
    features = tuple(Feature(n, ("min", "max", "sum", "var"), scale=0) for n in names)
    got = one(aggregate_history(df, HistoryFunction("f", "k", (Component("all", "", features),))))
    assert len(got) == 161
    assert got["c7_SUM"] == 15.0 and got["c39_MAX"] == 40.0 and got["c0_VAR"] == 0.5


def test_quotes_in_category_and_branch_values(spark):
    df = spark.createDataFrame([("k", "it's", 1.0), ("k", "a\\b", 2.0)], "k string, c string, v double")
    function = HistoryFunction(
        "f",
        "k",
        (Component("q", "Q_", (Feature("v", ("sum",), scale=0),), branch=("c", "it's")),),
        (CategoryShare("c", ("it's", "a\\b")),),
    )
    assert list(one(aggregate_history(df, function)).values()) == ["k", 1.0, 0.5, 0.5, 0.0]


def test_missing_columns_and_bad_specs_are_refused(spark):
    df = spark.createDataFrame([("k", 1.0)], "k string, v double")
    with pytest.raises(ValueError, match="missing columns: \\['w'\\]"):
        aggregate_history(df, HistoryFunction("f", "k", (Component("a", "", (Feature("w", ("sum",)),)),)))
    with pytest.raises(ValueError, match="unsupported"):
        Feature("v", ("median",))
    with pytest.raises(ValueError, match="unsupported transform"):
        Feature("v", ("sum",), "cube")
    double = HistoryFunction("f", "k", (Component("a", "", (Feature("v", ("sum",)),) * 2),))
    with pytest.raises(ValueError, match="repeated output"):
        aggregate_history(df, double)


