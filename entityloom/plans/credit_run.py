"""The whole credit run: features, fold-wise training, scores, AUC, importances."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from entityloom.operators.model import FoldResult, train_folds
from entityloom.operators.ordering import roc_auc, top_groups
from entityloom.plans import credit
from entityloom.plans.compile import feature_columns
from entityloom.session import materialise
from entityloom.sources.readers import first_rows, read_table
from entityloom.sources.sinks import write_submission

# The source tables and the number of features in the report.
TABLES = (
    "application_train",
    "application_test",
    "bureau",
    "bureau_balance",
    "previous_application",
    "POS_CASH_balance",
    "installments_payments",
    "credit_card_balance",
)
TOP_FEATURES = 40


@dataclass(frozen=True)
class CreditRun:
    features: DataFrame
    folds: FoldResult
    auc: DataFrame
    top_importance: DataFrame


def read_tables(spark: SparkSession, folder: str, limit: int = 0) -> dict[str, DataFrame]:
    """All source tables from one folder; ``limit`` keeps the first rows by key, 0 all."""
    tables = {name: read_table(spark, folder, name) for name in TABLES}
    if limit <= 0:
        return tables
    keys = {name: "SK_ID_BUREAU" if name == "bureau_balance" else credit.KEY for name in TABLES}
    return {name: first_rows(df, [keys[name]], limit) for name, df in tables.items()}


def run(
    tables: Mapping[str, DataFrame],
    submission: str | None = None,
    folds: int = 10,
    stratified: bool = False,
    categories: Mapping[str, credit.Categories] | None = None,
    **training,
) -> CreditRun:
    """Build the features, train per fold and score; optionally write the submission."""
    # Written once: training reads it per fold, and no fold repeats the aggregation.
    wide = materialise(credit.feature_table(tables, categories), "features")
    names = feature_columns(wide, credit.NOT_FEATURES)
    result = train_folds(wide, credit.KEY, credit.TARGET, names, folds, stratified=stratified, **training)
    if submission:
        write_submission(result.scores, submission, credit.KEY, "score", credit.TARGET)
    return CreditRun(
        features=wide,
        folds=result,
        auc=roc_auc(result.out_of_fold, "label", "score", "fold"),
        top_importance=top_groups(result.importance, "feature", "importance", TOP_FEATURES),
    )
