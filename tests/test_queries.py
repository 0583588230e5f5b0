"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from entityloom.plans.star_queries import QUERIES
from oracle.check import compare, connect
from oracle.star_sql import ORACLE_SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
WITHOUT_SQL = {"oof_predictions", "fold_mean_scores", "fold_importance"}


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_all_queries_have_sql_but_the_model_ones():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(queries())
    assert set(ORACLE_SQL) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query(spark, database, name):
    result = compare(spark, database, name, FOLDER)
    assert result.startswith("ok"), result


@pytest.mark.parametrize(
    ("name", "scans"), [("end_to_end_features", 4), ("fn_payment_behaviour", 2), ("fn_wide_numeric", 1)]
)
def test_scans_of_the_largest_table(spark, name, scans):
    """One scan of lines per order; one more per part that stays within generated code."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("lineitem.parquet") <= scans


@pytest.mark.parametrize(("rows", "moved"), [(1 << 20, True), (3, False)])
def test_wide_groupings_move_narrow_rows_unless_a_key_is_large(spark, database, monkeypatch, rows, moved):
    monkeypatch.setattr("entityloom.plans.compile.MAX_MOVED_ROWS", rows)
    plan = QUERIES["end_to_end_features"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert ("REBALANCE" in plan) == moved
    assert plan.count("lineitem.parquet") == (3 if moved else 4)
    for name in ("end_to_end_features", "fn_two_level_segmented", "fn_wide_numeric"):
        assert compare(spark, database, name, FOLDER).startswith("ok")


def test_importances_cover_the_missing_flags(spark):
    found = {r["feature"] for r in QUERIES["fold_importance"](spark, FOLDER).collect()}
    plain = {"n_chars", "source_number", "lang_de", "lang_en", "lang_es", "lang_fr", "lang_nan"}
    assert found == plain | {f"{c}_missing" for c in plain}


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and len(df.columns) > 200
