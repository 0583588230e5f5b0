"""The same feature functions on a star schema of customers, orders, lines and events.

Roles: customer is the entity; orders are its credits (status O open, F done)
with lineitem as child rows; lines joined to their order play previous
applications, instalments and card rows; events play the POS history.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from entityloom.functions import scalars
from entityloom.operators.encode import label_encode, one_hot
from entityloom.plans.compile import aggregate_histories, aggregate_history, numeric_columns
from entityloom.plans.spec import CategoryShare, Component, Feature, HistoryFunction
from entityloom.sources.readers import append, read_parquet

KEY = "c_custkey"
ANY = "min max mean sum var"

# Category lists of the star tables, the day zero of day offsets.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")
RETURN_FLAGS = ("A", "N", "R")
LINE_STATUSES = ("F", "O")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
DAY_ZERO = "1998-01-01"


def f(name: str, operations: str, scale: int, transform: str = "identity", *sources: str) -> Feature:
    return Feature(name, tuple(operations.split()), transform, sources, scale)


def rows_as(alias: str) -> Feature:
    return Feature("ROW_COUNT", ("size",), "rows", alias=alias)


def tables(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Reader of one data folder that opens each table once."""
    return cache(lambda name: read_parquet(spark, folder, name))


def days(column: str) -> Column:
    """Whole days since day zero."""
    return F.datediff(F.col(column).cast("date"), F.to_date(F.lit(DAY_ZERO)))


# --- history rows, each with the entity key -------------------------------------------------


LINES_PER_ORDER = HistoryFunction(
    "lines_per_order",
    "o_orderkey",
    (
        Component(
            "all",
            "",
            (
                f("l_linenumber", "min max size", 0),
                f("l_extendedprice", "max sum", 2),
                f("l_quantity", "sum", 2),
            ),
        ),
    ),
    (CategoryShare("l_returnflag", RETURN_FLAGS),),
)


def orders_with_lines(t) -> DataFrame:
    """Orders with the aggregates of their lines; lines are merged before the join."""
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = t("orders").withColumnRenamed("o_custkey", KEY).withColumn("days", days("o_orderdate"))
    return orders.join(aggregate_history(lines, LINES_PER_ORDER), "o_orderkey", "left")


def lines_of_customers(t) -> DataFrame:
    """Lines with customer, order price and day offsets."""
    orders = t("orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias(KEY),
        "o_totalprice",
        days("o_orderdate").alias("day_due"),
    )
    price = F.col("l_extendedprice")
    return (
        t("lineitem")
        .join(orders, "l_orderkey")
        .withColumns(
            {
                "day_paid": days("l_shipdate"),
                "amount_due": price,
                "amount_paid": price * (F.lit(1.0) - F.col("l_discount")),
                "discount": scalars.sentinel_to_null(F.col("l_discount"), 0.0),
            }
        )
        .withColumn("day_gap", F.col("day_paid") - F.col("day_due"))
    )


def events_of_customers(t) -> DataFrame:
    return t("events").select(
        F.col("user_id").alias(KEY), "event_id", "event_type", "value", F.hour("ts").alias("hour")
    )


# --- the six feature functions --------------------------------------------------------------

ORDER_FEATURES = (
    f("days", "min max mean var", 0),
    f("o_totalprice", "max mean sum", 2),
    f("l_extendedprice_SUM", "max mean sum", 2),
    f("l_extendedprice_MAX", "mean", 2),
    f("l_quantity_SUM", "sum", 2),
    f("l_linenumber_MIN", "min", 0),
    f("l_linenumber_MAX", "max", 0),
    f("l_linenumber_SIZE", "mean sum", 0),
)
CHILD_SHARES = tuple(f(name, "mean", 6) for s in LINES_PER_ORDER.shares for _, name in s.outputs())
ORDER_FUNCTION = HistoryFunction(
    "orders",
    KEY,
    (
        Component("all", "ORD_", ORDER_FEATURES + CHILD_SHARES),
        Component("open", "OPEN_", ORDER_FEATURES, branch=("o_orderstatus", "O")),
        Component("done", "DONE_", ORDER_FEATURES, branch=("o_orderstatus", "F")),
    ),
    (
        CategoryShare("o_orderstatus", STATUSES, prefix="ORD_"),
        CategoryShare("o_orderpriority", PRIORITIES, prefix="ORD_"),
    ),
)

LINE_FEATURES = (
    f("l_quantity", "min max mean", 2),
    f("l_extendedprice", "min max mean", 2),
    f("PRICE_SHARE", "min max mean var", 6, "ratio", "l_extendedprice", "o_totalprice"),
    f("l_tax", "min max mean", 2),
    f("discount", "min max mean", 2),
    f("day_gap", "min max mean", 0),
    f("l_linenumber", "mean sum", 0),
)
LINE_FUNCTION = HistoryFunction(
    "lines",
    KEY,
    (
        Component("all", "PREV_", LINE_FEATURES),
        Component("accepted", "ACC_", LINE_FEATURES, branch=("l_returnflag", "A")),
        Component("returned", "RET_", LINE_FEATURES, branch=("l_returnflag", "R")),
    ),
    (
        CategoryShare("l_returnflag", RETURN_FLAGS, prefix="PREV_"),
        CategoryShare("l_linestatus", LINE_STATUSES, prefix="PREV_"),
    ),
)

EVENT_FUNCTION = HistoryFunction(
    "events",
    KEY,
    (
        Component(
            "all", "EVT_", (f("value", "max mean size", 2), f("hour", "max mean", 0), rows_as("EVT_COUNT"))
        ),
    ),
    (CategoryShare("event_type", EVENT_TYPES, prefix="EVT_"),),
)

PAYMENT_FUNCTION = HistoryFunction(
    "payments",
    KEY,
    (
        Component(
            "all",
            "PAY_",
            (
                f("l_linenumber", "nunique", 0),
                f("DPD", "max mean sum", 0, "positive_difference_zero", "day_paid", "day_due"),
                f("DBD", "max mean sum", 0, "positive_difference_zero", "day_due", "day_paid"),
                f("PAID_PERC", "max mean sum var", 6, "ratio", "amount_paid", "amount_due"),
                f("PAID_DIFF", "max mean sum var", 2, "difference", "amount_due", "amount_paid"),
                f("amount_due", "max mean sum", 2),
                f("amount_paid", "min max mean sum", 2),
                f("day_paid", "max mean sum", 0),
                rows_as("PAY_COUNT"),
            ),
        ),
    ),
)


def wide_function(rows: DataFrame, prefix: str, key: str, drop: tuple[str, ...] = ()) -> HistoryFunction:
    """Every aggregate over every numeric column; whole numbers at scale 0, others at 2."""
    types = dict(rows.dtypes)
    features = tuple(
        f(name, ANY, 2 if types[name] == "double" else 0) for name in numeric_columns(rows, (key, *drop))
    )
    return HistoryFunction(
        "wide", key, (Component("all", prefix, (*features, rows_as(f"{prefix}COUNT"))),)
    )


LINE_COLUMNS = (
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_linestatus",
)


def with_line_dummies(lines: DataFrame) -> DataFrame:
    """Lines with 0/1 columns for the line status next to the original columns."""
    dummies, _ = one_hot(
        lines.withColumn("status", F.col("l_linestatus")), {"status": LINE_STATUSES}, True
    )
    return dummies


def line_wide_function(lines: DataFrame) -> HistoryFunction:
    kept = [c for c in lines.columns if c in LINE_COLUMNS or c.startswith("status_")]
    return wide_function(lines.select(KEY, *kept), "CC_", KEY)


def application(t) -> DataFrame:
    """Customers with a target for the labelled ones, encoded, with derived ratios."""
    base = t("customer").select(
        KEY,
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") < 0, "debit").otherwise("credit").alias("side"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
    )
    targets = t("labels").select(F.col("doc_id").alias(KEY), F.col("quality").alias("target"))
    train = base.join(targets, KEY)
    test = base.join(targets, KEY, "left_anti")
    rows = append(train, test)
    rows = rows.filter(scalars.differs_or_missing(F.col("segment"), "MACHINERY"))
    rows = label_encode(rows, ["side"], KEY)
    rows, _ = one_hot(rows, {"segment": SEGMENTS}, True)
    rows = rows.withColumn("nation", scalars.sentinel_to_null(F.col("nation"), 24))
    return rows.withColumns(
        {
            "balance_per_nation": scalars.ratio(F.col("balance"), F.col("nation")),
            "nation_per_balance": scalars.ratio(F.col("nation"), F.col("balance")),
        }
    )


def order_features(t) -> DataFrame:
    return aggregate_history(orders_with_lines(t), ORDER_FUNCTION)


def line_features(t) -> DataFrame:
    return aggregate_history(lines_of_customers(t), LINE_FUNCTION)


def event_features(t) -> DataFrame:
    return aggregate_history(events_of_customers(t), EVENT_FUNCTION)


def payment_features(t) -> DataFrame:
    return aggregate_history(lines_of_customers(t), PAYMENT_FUNCTION)


def wide_features(t) -> DataFrame:
    lines = with_line_dummies(lines_of_customers(t))
    return aggregate_history(lines, line_wide_function(lines))


def all_line_features(t) -> DataFrame:
    """The three functions over customers' lines, from one join and one grouping."""
    lines = with_line_dummies(lines_of_customers(t))
    return aggregate_histories(lines, [LINE_FUNCTION, PAYMENT_FUNCTION, line_wide_function(lines)])


def feature_table(t) -> DataFrame:
    """The application rows with all five history functions."""
    wide = application(t)
    for part in (order_features, event_features, all_line_features):
        wide = wide.join(part(t), KEY, "left")
    return wide


# --- the declarative functions with numbered components -------------------------------------

ROW_COUNT = Feature("ROW_COUNT", ("count",), "rows")
DECLARED_ORDERS = (
    f("days", "mean var", 0),
    f("o_totalprice", "mean sum", 2),
    Feature("l_linenumber_SIZE", ("mean", "sum"), "child_size", scale=0),
)
DECLARED_LINES = (
    f("l_quantity", "mean", 2),
    f("PRICE_SHARE", "mean var", 6, "ratio", "l_extendedprice", "o_totalprice"),
    f("l_linenumber", "mean sum", 0),
)
DECLARED = (
    HistoryFunction(
        "orders",
        KEY,
        (
            Component("B01", "ORD_", DECLARED_ORDERS, "all orders"),
            Component("B02", "OPEN_", DECLARED_ORDERS, "open orders", ("o_orderstatus", "O")),
            Component("B03", "DONE_", DECLARED_ORDERS, "done orders", ("o_orderstatus", "F")),
        ),
        table="orders",
    ),
    HistoryFunction(
        "lines",
        KEY,
        (
            Component("P01", "PREV_", DECLARED_LINES, "all lines"),
            Component("P02", "ACC_", DECLARED_LINES, "accepted lines", ("l_returnflag", "A")),
            Component("P03", "RET_", DECLARED_LINES, "returned lines", ("l_returnflag", "R")),
        ),
        table="lines",
    ),
    HistoryFunction(
        "events",
        KEY,
        (
            Component("POS01", "EVT_", (ROW_COUNT,), "event count"),
            Component("POS02", "EVT_", (f("value", "mean", 2), f("hour", "mean", 0)), "event means"),
        ),
        table="events",
    ),
    HistoryFunction(
        "payments",
        KEY,
        (
            Component("I01", "PAY_", (ROW_COUNT,), "payment count"),
            Component(
                "I02",
                "PAY_",
                (
                    f("DPD", "mean sum", 0, "positive_difference", "day_paid", "day_due"),
                    f("PAID_PERC", "mean sum var", 6, "ratio", "amount_paid", "amount_due"),
                    f("amount_paid", "mean sum", 2),
                ),
                "payment aggregates",
            ),
            Component(
                "I03",
                "PAY_",
                (f("PAID_DIFF", "mean sum var", 2, "difference", "amount_due", "amount_paid"),),
                "payment difference",
            ),
        ),
        table="lines",
    ),
    HistoryFunction(
        "wide",
        KEY,
        (
            Component("C01", "CC_", (ROW_COUNT,), "line count"),
            Component(
                "C02",
                "CC_",
                (
                    f("l_quantity", "mean sum var", 2),
                    f("l_extendedprice", "mean sum var", 2),
                    f("l_tax", "mean sum var", 2),
                ),
                "line aggregates",
            ),
        ),
        table="lines",
    ),
)
HISTORY = {"orders": orders_with_lines, "lines": lines_of_customers, "events": events_of_customers}
