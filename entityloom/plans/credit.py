"""The credit-risk workload on its real source tables.

Input tables are DataFrames under their source names: ``application_train``,
``application_test``, ``bureau``, ``bureau_balance``, ``previous_application``,
``POS_CASH_balance``, ``installments_payments``, ``credit_card_balance``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from entityloom.functions import scalars
from entityloom.operators.align import restricted_child_count
from entityloom.operators.encode import (
    categorical_columns,
    discover_categories,
    label_encode,
    one_hot,
    shares_of,
)
from entityloom.plans.compile import aggregate_history, numeric_columns
from entityloom.plans.spec import CategoryShare, Component, Feature, HistoryFunction
from entityloom.sources.readers import append, require_columns

KEY = "SK_ID_CURR"
TARGET = "TARGET"
NOT_FEATURES = ("TARGET", "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index")

# The aggregates per source column, the derived columns, the
# branches and the sentinel of the workload.
SENTINEL = 365243
SENTINEL_COLUMNS = (
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
)
BINARY_COLUMNS = ("CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY")
APPLICATION_RATIOS = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
}
BUREAU_NUMERIC = {
    "DAYS_CREDIT": "min max mean var",
    "DAYS_CREDIT_ENDDATE": "min max mean",
    "DAYS_CREDIT_UPDATE": "mean",
    "CREDIT_DAY_OVERDUE": "max mean",
    "AMT_CREDIT_MAX_OVERDUE": "mean",
    "AMT_CREDIT_SUM": "max mean sum",
    "AMT_CREDIT_SUM_DEBT": "max mean sum",
    "AMT_CREDIT_SUM_OVERDUE": "mean",
    "AMT_CREDIT_SUM_LIMIT": "mean sum",
    "AMT_ANNUITY": "max mean",
    "CNT_CREDIT_PROLONG": "sum",
    "MONTHS_BALANCE_MIN": "min",
    "MONTHS_BALANCE_MAX": "max",
    "MONTHS_BALANCE_SIZE": "mean sum",
}
PREVIOUS_NUMERIC = {
    "AMT_ANNUITY": "min max mean",
    "AMT_APPLICATION": "min max mean",
    "AMT_CREDIT": "min max mean",
    "APP_CREDIT_PERC": "min max mean var",
    "AMT_DOWN_PAYMENT": "min max mean",
    "AMT_GOODS_PRICE": "min max mean",
    "HOUR_APPR_PROCESS_START": "min max mean",
    "RATE_DOWN_PAYMENT": "min max mean",
    "DAYS_DECISION": "min max mean",
    "CNT_PAYMENT": "mean sum",
}
POS_NUMERIC = {"MONTHS_BALANCE": "max mean size", "SK_DPD": "max mean", "SK_DPD_DEF": "max mean"}
INSTALLMENT_NUMERIC = {
    "NUM_INSTALMENT_VERSION": "nunique",
    "DPD": "max mean sum",
    "DBD": "max mean sum",
    "PAYMENT_PERC": "max mean sum var",
    "PAYMENT_DIFF": "max mean sum var",
    "AMT_INSTALMENT": "max mean sum",
    "AMT_PAYMENT": "min max mean sum",
    "DAYS_ENTRY_PAYMENT": "max mean sum",
}
CARD_NUMERIC = (
    "MONTHS_BALANCE",
    "AMT_BALANCE",
    "AMT_CREDIT_LIMIT_ACTUAL",
    "AMT_DRAWINGS_ATM_CURRENT",
    "AMT_DRAWINGS_CURRENT",
    "AMT_DRAWINGS_OTHER_CURRENT",
    "AMT_DRAWINGS_POS_CURRENT",
    "AMT_INST_MIN_REGULARITY",
    "AMT_PAYMENT_CURRENT",
    "AMT_PAYMENT_TOTAL_CURRENT",
    "AMT_RECEIVABLE_PRINCIPAL",
    "AMT_RECIVABLE",
    "AMT_TOTAL_RECEIVABLE",
    "CNT_DRAWINGS_ATM_CURRENT",
    "CNT_DRAWINGS_CURRENT",
    "CNT_DRAWINGS_OTHER_CURRENT",
    "CNT_DRAWINGS_POS_CURRENT",
    "CNT_INSTALMENT_MATURE_CUM",
    "SK_DPD",
    "SK_DPD_DEF",
)
CARD_OPERATIONS = ("min", "max", "mean", "sum", "var")
DERIVED = {
    "APP_CREDIT_PERC": ("ratio", ("AMT_APPLICATION", "AMT_CREDIT")),
    "PAYMENT_PERC": ("ratio", ("AMT_PAYMENT", "AMT_INSTALMENT")),
    "PAYMENT_DIFF": ("difference", ("AMT_INSTALMENT", "AMT_PAYMENT")),
    "DPD": ("positive_difference_zero", ("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")),
    "DBD": ("positive_difference_zero", ("DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT")),
}
BUREAU_BRANCHES = {"ACTIVE_": ("CREDIT_ACTIVE", "Active"), "CLOSED_": ("CREDIT_ACTIVE", "Closed")}
PREVIOUS_BRANCHES = {
    "APPROVED_": ("NAME_CONTRACT_STATUS", "Approved"),
    "REFUSED_": ("NAME_CONTRACT_STATUS", "Refused"),
}


def features_of(operations: Mapping[str, str], scale: int | None = None) -> tuple[Feature, ...]:
    made = []
    for name, ops in operations.items():
        transform, sources = DERIVED.get(name, ("identity", ()))
        made.append(Feature(name, tuple(ops.split()), transform, sources, scale))
    return tuple(made)


def _row_count(name: str) -> Feature:
    return Feature("ROW_COUNT", ("size",), "rows", alias=name)


def _branched(
    name: str,
    table: str,
    prefix: str,
    features: tuple[Feature, ...],
    branches: Mapping[str, tuple[str, str]],
    shares: Sequence[CategoryShare],
    general_only: tuple[Feature, ...] = (),
) -> HistoryFunction:
    general = Component("all", prefix, features + general_only, "all rows")
    parts = [Component(p.strip("_").lower(), p, features, v, (c, v)) for p, (c, v) in branches.items()]
    return HistoryFunction(name, KEY, (general, *parts), tuple(shares), table)


Categories = Mapping[str, Sequence[str]]


def _categories(df: DataFrame, given: Categories | None, skip: Sequence[str] = ()) -> Categories:
    """Frozen category lists, or those found by one pass over the string columns."""
    if given is not None:
        return given
    return discover_categories(df, [c for c in categorical_columns(df) if c not in skip])


def application_features(
    train: DataFrame,
    test: DataFrame,
    categories: Categories | None = None,
    missing_category: bool = False,
    order: str = KEY,
) -> DataFrame:
    """Train and test rows together, encoded, with the derived ratios."""
    rows = append(train, test)
    rows = rows.filter(scalars.differs_or_missing(F.col("CODE_GENDER"), "XNA"))
    categories = _categories(rows, categories, BINARY_COLUMNS)
    rows = label_encode(rows, BINARY_COLUMNS, order)
    rows, _ = one_hot(rows, categories, missing_category)
    rows = rows.withColumn("DAYS_EMPLOYED", scalars.sentinel_to_null(F.col("DAYS_EMPLOYED"), SENTINEL))
    return rows.withColumns(
        {name: scalars.ratio(F.col(a), F.col(b)) for name, (a, b) in APPLICATION_RATIOS.items()}
    )


def balance_per_credit(balance: DataFrame, categories: Categories) -> DataFrame:
    months = Feature("MONTHS_BALANCE", ("min", "max", "size"))
    child = HistoryFunction(
        "bureau_balance", "SK_ID_BUREAU", (Component("all", "", (months,)),), shares_of(categories)
    )
    return aggregate_history(balance, child)


def bureau_features(
    bureau: DataFrame,
    balance: DataFrame,
    categories: Categories | None = None,
    balance_categories: Categories | None = None,
) -> DataFrame:
    balance_categories = _categories(balance, balance_categories)
    joined = bureau.join(balance_per_credit(balance, balance_categories), "SK_ID_BUREAU", "left")
    child_shares = [name for s in shares_of(balance_categories) for _, name in s.outputs()]
    function = _branched(
        "bureau",
        "bureau",
        "BURO_",
        features_of(BUREAU_NUMERIC),
        BUREAU_BRANCHES,
        shares_of(_categories(bureau, categories), "BURO_"),
        tuple(Feature(name, ("mean",)) for name in child_shares),
    )
    return aggregate_history(joined, function)


def previous_features(previous: DataFrame, categories: Categories | None = None) -> DataFrame:
    shares = shares_of(_categories(previous, categories), "PREV_")
    present = [c for c in SENTINEL_COLUMNS if c in previous.columns]
    rows = previous.withColumns({c: scalars.sentinel_to_null(F.col(c), SENTINEL) for c in present})
    function = _branched(
        "previous",
        "previous_application",
        "PREV_",
        features_of(PREVIOUS_NUMERIC),
        PREVIOUS_BRANCHES,
        shares,
    )
    return aggregate_history(rows, function)


def _counted(
    rows: DataFrame,
    name: str,
    prefix: str,
    features: tuple[Feature, ...],
    count: str,
    categories: Categories | None,
) -> DataFrame:
    shares = shares_of(_categories(rows, categories), prefix)
    component = Component("all", prefix, (*features, _row_count(count)))
    return aggregate_history(rows, HistoryFunction(name, KEY, (component,), shares))


def pos_features(pos: DataFrame, categories: Categories | None = None) -> DataFrame:
    return _counted(pos, "pos", "POS_", features_of(POS_NUMERIC), "POS_COUNT", categories)


def installment_features(rows: DataFrame, categories: Categories | None = None) -> DataFrame:
    numeric = features_of(INSTALLMENT_NUMERIC)
    return _counted(rows, "installments", "INSTAL_", numeric, "INSTAL_COUNT", categories)


def card_features(card: DataFrame, categories: Categories | None = None) -> DataFrame:
    """All five aggregates over every remaining column, 0/1 columns included."""
    rows, _ = one_hot(card.drop("SK_ID_PREV"), _categories(card, categories), True)
    features = tuple(Feature(c, CARD_OPERATIONS) for c in numeric_columns(rows, [KEY]))
    return _counted(rows, "credit_card", "CC_", features, "CC_COUNT", {})


def feature_table(
    tables: Mapping[str, DataFrame], categories: Mapping[str, Categories] | None = None
) -> DataFrame:
    """Application rows with all history features, one row per application.

    ``categories`` holds frozen category lists per table name; a table without
    an entry has its categories discovered by a pass of its own.
    """
    c = categories or {}
    t = tables
    require_columns(t["application_train"], [KEY, TARGET], "application_train")
    wide = application_features(t["application_train"], t["application_test"], c.get("application"))
    for part in (
        bureau_features(
            t["bureau"], t["bureau_balance"], c.get("bureau"), c.get("bureau_balance")
        ),
        previous_features(t["previous_application"], c.get("previous_application")),
        pos_features(t["POS_CASH_balance"], c.get("POS_CASH_balance")),
        installment_features(t["installments_payments"], c.get("installments_payments")),
        card_features(t["credit_card_balance"], c.get("credit_card_balance")),
    ):
        wide = wide.join(part, KEY, "left")
    return wide


# The five declarative functions with their 13 components, which
# keep the additive operations only.
def _moments(names: Sequence[str], operations: str) -> tuple[Feature, ...]:
    return tuple(Feature(n, tuple(operations.split())) for n in names)


ROW_COUNT = Feature("ROW_COUNT", ("count",), "rows")
BUREAU_DECLARED = (
    *features_of(
        {
            "DAYS_CREDIT": "mean var",
            "DAYS_CREDIT_ENDDATE": "mean",
            "DAYS_CREDIT_UPDATE": "mean",
            "CREDIT_DAY_OVERDUE": "mean",
            "AMT_CREDIT_MAX_OVERDUE": "mean",
            "AMT_CREDIT_SUM": "mean sum",
            "AMT_CREDIT_SUM_DEBT": "mean sum",
            "AMT_CREDIT_SUM_OVERDUE": "mean",
            "AMT_CREDIT_SUM_LIMIT": "mean sum",
            "AMT_ANNUITY": "mean",
            "CNT_CREDIT_PROLONG": "sum",
        }
    ),
    Feature("MONTHS_BALANCE_SIZE", ("mean", "sum"), "child_size"),
)
PREVIOUS_DECLARED = features_of(
    {
        "AMT_ANNUITY": "mean",
        "AMT_APPLICATION": "mean",
        "AMT_CREDIT": "mean",
        "APP_CREDIT_PERC": "mean var",
        "AMT_DOWN_PAYMENT": "mean",
        "AMT_GOODS_PRICE": "mean",
        "HOUR_APPR_PROCESS_START": "mean",
        "RATE_DOWN_PAYMENT": "mean",
        "DAYS_DECISION": "mean",
        "CNT_PAYMENT": "mean sum",
    }
)
INSTALLMENTS_DECLARED = (
    Feature("DPD", ("mean", "sum"), "positive_difference", ("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")),
    Feature("DBD", ("mean", "sum"), "positive_difference", ("DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT")),
    Feature("PAYMENT_PERC", ("mean", "sum", "var"), "ratio", ("AMT_PAYMENT", "AMT_INSTALMENT")),
    *_moments(("AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_ENTRY_PAYMENT"), "mean sum"),
)
PAYMENT_DIFFERENCE = Feature(
    "PAYMENT_DIFF", ("mean", "sum", "var"), "difference", ("AMT_INSTALMENT", "AMT_PAYMENT")
)
DECLARED_FUNCTIONS = (
    HistoryFunction(
        "bureau",
        KEY,
        (
            Component("B01", "BURO_", BUREAU_DECLARED, "Bureau, all credits"),
            Component("B02", "ACTIVE_", BUREAU_DECLARED, "Bureau, active", BUREAU_BRANCHES["ACTIVE_"]),
            Component("B03", "CLOSED_", BUREAU_DECLARED, "Bureau, closed", BUREAU_BRANCHES["CLOSED_"]),
        ),
        table="bureau",
    ),
    HistoryFunction(
        "previous",
        KEY,
        (
            Component("P01", "PREV_", PREVIOUS_DECLARED, "Previous, all"),
            Component(
                "P02", "APPROVED_", PREVIOUS_DECLARED, "Previous, approved", PREVIOUS_BRANCHES["APPROVED_"]
            ),
            Component(
                "P03", "REFUSED_", PREVIOUS_DECLARED, "Previous, refused", PREVIOUS_BRANCHES["REFUSED_"]
            ),
        ),
        table="previous_application",
    ),
    HistoryFunction(
        "pos",
        KEY,
        (
            Component("POS01", "POS_", (ROW_COUNT,), "POS row count"),
            Component(
                "POS02", "POS_", _moments(("MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF"), "mean"), "POS means"
            ),
        ),
        table="POS_CASH_balance",
    ),
    HistoryFunction(
        "installments",
        KEY,
        (
            Component("I01", "INSTAL_", (ROW_COUNT,), "Installment row count"),
            Component("I02", "INSTAL_", INSTALLMENTS_DECLARED, "Installment aggregates"),
            Component("I03", "INSTAL_", (PAYMENT_DIFFERENCE,), "Payment difference"),
        ),
        table="installments_payments",
    ),
    HistoryFunction(
        "credit_card",
        KEY,
        (
            Component("C01", "CC_", (ROW_COUNT,), "Card row count"),
            Component("C02", "CC_", _moments(CARD_NUMERIC, "mean sum var"), "Card aggregates"),
        ),
        table="credit_card_balance",
    ),
)


def with_balance_size(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Bureau rows with the number of balance rows of each, counted for these rows only."""
    sizes = restricted_child_count(balance, bureau, "SK_ID_BUREAU", "MONTHS_BALANCE_SIZE")
    return bureau.join(sizes, "SK_ID_BUREAU", "left")
