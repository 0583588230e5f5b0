"""Registered queries: one or more per operator, over the whole star tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from entityloom.functions import arrays, scalars
from entityloom.operators import align, encode, model, moments, ordering, stage, validate, vectors
from entityloom.plans import star
from entityloom.plans.compile import (
    aggregate_history,
    attach,
    bundle_features,
    feature_columns,
    long_features,
    missing_counts,
    sufficient_statistics,
)
from entityloom.plans.spec import CategoryShare, Component, HistoryFunction, find_function
from entityloom.plans.star import KEY, f, rows_as
from entityloom.sources import sinks
from entityloom.sources.readers import append, first_rows, read_csv, read_csv_text, require_columns, split_labelled
from entityloom.session import materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries, shared with their SQL.
SEED = 7
FOLDS = 10
CHUNK = 32
TOLERANCE = 1e-4
LINE_WEIGHTS = (0.5, -0.001, 12.0, 3.25)
LINE_BIAS = 1.5
POLYNOMIAL = (0.25, -1.5, 0.75, 2.0)


def query(make: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Query:
    """Register ``make(tables)`` under its own name, without a trailing ``_query``."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return make(star.tables(spark, folder))

    QUERIES[make.__name__.removesuffix("_query")] = run
    return run


# --- scans and scalar transforms ------------------------------------------------------------


@query
def scan_limit(t):
    return first_rows(t("customer").select(KEY, "c_mktsegment"), [KEY], 10)


@query
def numeric_parse(t):
    nation = F.col("c_nationkey")
    text = (
        F.when(nation == 0, "inf")
        .when(nation == 1, "nan")
        .when(nation == 2, "  ")
        .when(nation == 3, " 12.5 ")
        .when(nation == 4, "1e3")
        .when(nation == 5, "7d")
        .otherwise(F.col("c_name"))
    )
    digits = F.element_at(F.split("c_name", "#"), 2)
    return t("customer").select(
        KEY,
        scalars.parse_number(digits).alias("name_number"),
        scalars.parse_number(text).alias("mixed_number"),
        scalars.parse_number(F.col("c_mktsegment")).alias("segment_number"),
    )


@query
def key_normalise(t):
    raw = F.when(F.col("c_nationkey") == 0, F.lit(" \t ")).otherwise(
        F.concat(F.lit("\t "), F.col("c_name"), F.lit(" \n"))
    )
    return t("customer").select(KEY, scalars.normalise_key(raw).alias("key"))


def labelled_documents(t) -> DataFrame:
    """Documents with a target, and after them those without one."""
    documents = t("documents").select("doc_id", "lang", "source", "n_chars")
    train = documents.join(t("labels").select("doc_id", F.col("quality").alias("target")), "doc_id")
    test = documents.join(t("labels"), "doc_id", "left_anti")
    return append(train, test)


@query
def append_missing_cols(t):
    return labelled_documents(t).select("doc_id", "lang", "n_chars", "target")


@query
def label_split(t):
    known, unknown = split_labelled(labelled_documents(t), "target")
    return known.select("doc_id", F.lit("train").alias("part")).unionByName(
        unknown.select("doc_id", F.lit("test").alias("part"))
    )


@query
def filter_ne_keep_null(t):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    rows = t("customer").select(KEY, segment.alias("segment"))
    return rows.filter(scalars.differs_or_missing(F.col("segment"), "MACHINERY"))


@query
def sentinel_to_null(t):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", scalars.sentinel_to_null(F.col("l_discount"), 0.0).alias("discount")
    )


@query
def ratio_features(t):
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    return t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalars.ratio(price, discount).alias("price_per_discount"),
        scalars.ratio(price, quantity).alias("price_per_unit"),
        scalars.ratio(discount, tax).alias("discount_per_tax"),
        scalars.ratio(quantity, price).alias("units_per_price"),
        scalars.ratio(quantity, F.col("l_linenumber")).alias("units_per_line"),
    )


@query
def difference_feature(t):
    return star.lines_of_customers(t).select(
        "l_orderkey",
        "l_linenumber",
        scalars.difference(F.col("amount_due"), F.col("amount_paid")).alias("paid_diff"),
    )


@query
def positive_difference(t):
    late = F.nullif("day_paid", F.col("l_linenumber"))
    rows = star.lines_of_customers(t).withColumn("paid", late)
    paid, due = F.col("paid"), F.col("day_due")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        scalars.positive_difference(paid, due, "drop").alias("past_due"),
        scalars.positive_difference(due, paid, "drop").alias("before_due"),
        scalars.positive_difference(paid, due, "zero").alias("past_due_zero"),
        scalars.positive_difference(due, paid, "zero").alias("before_due_zero"),
    )


@query
def label_encode(t):
    rows = t("orders").select(
        "o_orderkey", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status")
    )
    return encode.label_encode(rows, ["o_orderpriority", "status"], "o_orderkey")


@query
def one_hot(t):
    rows = t("customer").select(KEY, F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return encode.one_hot(rows, {"segment": star.SEGMENTS}, True)[0]


@query
def one_hot_discovered(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.one_hot(rows, encode.discover_categories(rows), False)[0]


@query
def branch_mask(t):
    status = F.col("o_orderstatus")
    return t("orders").select(
        "o_orderkey",
        scalars.branch_mask(status, "O").alias("open_mask"),
        scalars.branch_mask(F.nullif(status, F.lit("F")), "P").alias("other_mask"),
    )


@query
def missing_compaction(t):
    """Rows without a value per feature; these are left out of vectors and statistics."""
    line = (
        f("discount", "mean", 2),
        f("DISC_PER_TAX", "mean", 6, "ratio", "l_discount", "l_tax"),
        f("PAID_DIFF", "mean", 2, "difference", "amount_due", "amount_paid"),
    )
    function = HistoryFunction("lines", KEY, (Component("M01", "", line),))
    return missing_counts(star.lines_of_customers(t), function)


@query
def linear_score(t):
    columns = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", scalars.linear_score(columns, LINE_WEIGHTS, LINE_BIAS).alias("score")
    )


@query
def linear_score_array(t):
    weights = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i / F.lit(64.0))
    return t("embeddings").select(
        "vec_id", arrays.linear_score(F.col("embedding"), weights, LINE_BIAS).alias("score")
    )


@query
def polynomial_score(t):
    return t("events").select(
        "event_id", scalars.polynomial_score(F.col("value") / F.lit(100.0), POLYNOMIAL).alias("score")
    )


# --- grouped aggregates ---------------------------------------------------------------------


def _orders(t) -> DataFrame:
    return t("orders").withColumnRenamed("o_custkey", KEY)


PRICE_FUNCTION = HistoryFunction(
    "prices",
    KEY,
    (Component("all", "", (f("o_totalprice", "count min max mean sum var", 2), rows_as("orders"))),),
)
SEGMENT_FUNCTION = HistoryFunction(
    "segments",
    KEY,
    (
        Component("all", "ALL_", (f("o_totalprice", "size mean sum var", 2),)),
        Component("open", "OPEN_", (f("o_totalprice", "size mean sum var", 2),), branch=("o_orderstatus", "O")),
        Component("done", "DONE_", (f("o_totalprice", "size mean sum var", 2),), branch=("o_orderstatus", "F")),
    ),
)


@query
def grouped_multi_agg(t):
    return aggregate_history(_orders(t), PRICE_FUNCTION)


@query
def group_count(t):
    return aggregate_history(
        star.events_of_customers(t), HistoryFunction("n", KEY, (Component("n", "", (rows_as("events"),)),))
    )


@query
def group_nunique(t):
    features = (f("l_linenumber", "nunique", 0), f("l_partkey", "nunique", 0), rows_as("lines"))
    function = HistoryFunction("n", "l_suppkey", (Component("n", "", features),))
    return aggregate_history(t("lineitem"), function)


@query
def category_share(t):
    shares = (
        CategoryShare("o_orderpriority", star.PRIORITIES),
        CategoryShare("o_orderstatus", star.STATUSES, missing=False),
    )
    return aggregate_history(_orders(t), HistoryFunction("s", KEY, (), shares))


@query
def two_level_agg(t):
    features = (
        f("l_linenumber_MIN", "min", 0),
        f("l_linenumber_MAX", "max", 0),
        f("l_linenumber_SIZE", "mean sum", 0),
        *star.CHILD_SHARES,
    )
    function = HistoryFunction("two", KEY, (Component("two", "ORD_", features),))
    return aggregate_history(star.orders_with_lines(t), function)


@query
def segmented_agg(t):
    return aggregate_history(_orders(t), SEGMENT_FUNCTION)


@query
def segmented_agg_zero(t):
    """The zero mode: counts and sums of an empty branch or history are 0."""
    entity = t("customer").select(KEY)
    totals = HistoryFunction(
        "zero",
        KEY,
        (
            Component("all", "ALL_", (f("value", "count sum mean", 2),)),
            Component("buy", "BUY_", (f("value", "count sum mean", 2),), branch=("event_type", "purchase")),
        ),
    )
    features = aggregate_history(star.events_of_customers(t), totals, "zero")
    return attach(entity, features, KEY, [totals], "zero")


@query
def wide_agg_all_numeric(t):
    lines = t("lineitem").drop("l_orderkey")
    return aggregate_history(lines, star.wide_function(lines, "CC_", "l_suppkey"))


@query
def masked_moments(t):
    mask = scalars.branch_mask(F.col("l_returnflag"), "A")
    return moments.masked_moments(t("lineitem"), "l_suppkey", F.col("l_extendedprice"), mask, 2)


@query
def difference_moments(t):
    mask = scalars.branch_mask(F.col("l_returnflag"), "R")
    return moments.difference_moments(
        star.lines_of_customers(t), KEY, F.col("amount_due"), F.col("amount_paid"), mask, 2
    )


@query
def dot_product_agg(t):
    return moments.dot_product(
        t("lineitem"), "l_suppkey", F.col("l_quantity"), F.col("l_extendedprice"), 2
    )


@query
def finalise_moments(t):
    units = F.col("value") * F.lit(100.0)
    stats = t("events").select("user_id", F.rint(units).alias("cents")).groupBy("user_id")
    sums = stats.agg(
        F.count("cents").alias("n"),
        F.sum("cents").alias("s"),
        F.sum(F.col("cents") * F.col("cents")).alias("ss"),
    )
    return moments.finalise(sums, "n", "s", "ss")


@query
def chunked_dot_product(t):
    cells = t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("position", "x"))
    right = (F.col("position") + 1) / F.lit(64.0)
    return moments.chunked_dot_product(cells, "vec_id", "position", F.col("x"), right, CHUNK, 6)


@query
def restricted_child_count(t):
    parents = t("orders").filter(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("l_orderkey"))
    return align.restricted_child_count(t("lineitem"), parents, "l_orderkey")


def _layout(t) -> DataFrame:
    """Customers in their receiver slots."""
    return align.receiver_layout(t("customer").select(KEY), KEY, SEED)


@query
def sufficient_stats(t):
    """Long count, sum and sum of squares per slot, component and feature."""
    function = star.DECLARED[0]
    return sufficient_statistics(_layout(t), star.HISTORY[function.table](t), function)


@query
def presence_flag(t):
    function = star.DECLARED[2]
    stats = sufficient_statistics(_layout(t), star.HISTORY[function.table](t), function)
    return moments.presence(stats, "app_index", "count")


@query
def long_features_query(t):
    function = star.DECLARED[2]
    return long_features(_layout(t), star.HISTORY[function.table](t), function)



@query
def scan_counters(t):
    return align.scan_counters(star.events_of_customers(t), t("customer").select(KEY), KEY)


def _rounded_means(t) -> tuple[DataFrame, DataFrame]:
    exact = aggregate_history(_orders(t), PRICE_FUNCTION).select(
        KEY, F.col("o_totalprice_MEAN").alias("value")
    )
    return exact, exact.select(KEY, (F.rint(F.col("value") * 1000.0) / 1000.0).alias("value"))


@query
def tolerance_compare(t):
    return validate.tolerance_compare(*_rounded_means(t), KEY, "value", TOLERANCE)


@query
def tolerance_summary(t):
    details = validate.tolerance_compare(*_rounded_means(t), KEY, "value", TOLERANCE)
    return validate.tolerance_summary(details)


@query
def topk_mean(t):
    rows = t("part").select("p_partkey", "p_brand", "p_retailprice")
    return ordering.top_groups(rows, "p_brand", "p_retailprice", 5)


@query
def mean_by_group(t):
    return ordering.mean_by_group(t("lineitem"), "l_partkey", "l_extendedprice")


# --- the feature functions ------------------------------------------------------------------


@query
def fn_application(t):
    return star.application(t)


@query
def fn_two_level_segmented(t):
    return star.order_features(t)


@query
def fn_segmented_ratio(t):
    return star.line_features(t)


@query
def fn_count_means(t):
    return star.event_features(t)


@query
def fn_payment_behaviour(t):
    return star.payment_features(t)


@query
def fn_wide_numeric(t):
    return star.wide_features(t)


@query
def end_to_end_features(t):
    return star.feature_table(t)


# --- joins and alignment --------------------------------------------------------------------


@query
def left_join_features(t):
    function = HistoryFunction(
        "minimum",
        KEY,
        (
            Component("all", "EVT_", (f("value", "count min max mean sum var", 2),)),
            Component("buy", "BUY_", (f("value", "count min max mean sum var", 2),), branch=("event_type", "purchase")),
        ),
    )
    entity = t("customer").select(KEY, "c_nationkey")
    return attach(entity, aggregate_history(star.events_of_customers(t), function), KEY)


@query
def selected_entity_probe(t):
    chosen = t("customer").filter(F.col("c_acctbal") < 0).select(KEY)
    orders = _orders(t).select(KEY, "o_orderkey", "o_totalprice")
    return align.probe(orders, chosen, KEY)


@query
def semi_join_keys(t):
    urgent = _orders(t).filter(F.col("o_orderpriority") == "1-URGENT").select(KEY)
    return align.with_key_in(t("customer").select(KEY, "c_name"), urgent, KEY)


@query
def anti_join_keys(t):
    return align.with_key_not_in(t("customer").select(KEY, "c_name"), star.events_of_customers(t), KEY)


def _event_keys(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias(KEY)).distinct()


@query
def aligned_layout(t):
    return align.aligned_layout(_layout(t), _event_keys(t), KEY)


@query
def match_mapping(t):
    return align.match_mapping(_layout(t), _event_keys(t), KEY)


@query
def presence_mask(t):
    return align.presence_mask(_layout(t), _event_keys(t), KEY)


@query
def alignment_counts(t):
    return align.alignment_counts(_layout(t), _event_keys(t), KEY)


@query
def bundle_join(t):
    """All functions' long features in one table, tagged with function and presence.

    The slots are written once; each history table is grouped and joined once.
    """
    histories = {name: rows(t) for name, rows in star.HISTORY.items()}
    return bundle_features(materialise(_layout(t), "layout"), histories, star.DECLARED)


# --- ordering, folds, ranking ---------------------------------------------------------------


@query
def dense_index(t):
    return ordering.dense_index(t("customer").select(KEY, "c_name"), ["c_name"])


@query
def shuffled_dense_index(t):
    return _layout(t)


@query
def kfold_assign(t):
    return ordering.kfold(t("customer").select(KEY), KEY, FOLDS)


@query
def stratified_kfold(t):
    rows = t("labels").select("doc_id", "quality")
    return ordering.stratified_kfold(rows, "doc_id", "quality", FOLDS)


def _scored_documents(t) -> DataFrame:
    scored = t("documents").select("doc_id", F.floor(F.col("n_chars") / 10).alias("score"))
    rows = scored.join(t("labels").select("doc_id", "quality"), "doc_id")
    return ordering.kfold(rows, "doc_id", FOLDS)


@query
def roc_auc(t):
    """Per fold, and over all folds as fold -1."""
    result = ordering.roc_auc(_scored_documents(t), "quality", "score", "fold")
    return result.withColumn("fold", F.coalesce("fold", F.lit(-1)))


# --- key sets -------------------------------------------------------------------------------


@query
def distinct_keys(t):
    return align.distinct_keys(t("lineitem"), "l_orderkey")


@query
def key_audit(t):
    return align.key_audit(t("lineitem"), "l_orderkey")


def _senders(t):
    return {
        "orders": (t("orders"), "o_custkey"),
        "events": (t("events"), "user_id"),
        "supplier": (t("supplier"), "s_suppkey"),
        "nation": (t("nation"), "n_nationkey"),
    }


@query
def key_union(t):
    return align.key_union(_senders(t))


@query
def key_union_audit(t):
    return align.key_union_audit(_senders(t))


@query
def key_intersection(t):
    return t("customer").select(F.col(KEY).alias("key")).intersect(
        t("events").select(F.col("user_id").alias("key"))
    )


@query
def key_difference(t):
    return t("customer").select(F.col(KEY).alias("key")).subtract(
        t("events").select(F.col("user_id").alias("key"))
    )


# --- vectors --------------------------------------------------------------------------------


def _purchases(t) -> DataFrame:
    """Event values with the purchase branch as mask."""
    mask = scalars.branch_mask(F.col("event_type"), "purchase")
    return star.events_of_customers(t).select(KEY, "event_id", "value", "hour", mask.alias("mask"))


def _packed(t, size: int = vectors.CHUNK_CELLS) -> tuple[DataFrame, int]:
    rows = _purchases(t)
    width = vectors.pack_width(rows, KEY)
    slots = _layout(t)
    packed = vectors.pack_vectors(
        slots, rows, KEY, ["value", "hour", "mask"], ["event_id"], size=size
    )
    return packed, width


def _cents(name: str):
    """An array as the text of its values in hundredths."""
    cents = F.transform(name, lambda x: F.rint(x * 100.0).cast("bigint").cast("string"))
    return F.array_join(cents, ",").alias(f"{name}_cents")


@query
def pack_vectors(t):
    """Packed vectors in chunks, each array shown as the text of its scaled integers."""
    packed, _ = _packed(t, CHUNK)
    return packed.select(
        "app_index", "chunk", F.size("value").alias("cells"), _cents("value"), _cents("hour"), _cents("mask")
    )


# Fixed value: a line has no key of its own; these columns order lines up to equal rows.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate")


@query
def pack_difference_vectors(t):
    """Both sides and the branch mask of a difference feature, packed from its spec."""
    feature = f("PAID_DIFF", "sum", 2, "difference", "amount_due", "amount_paid")
    component = Component("D01", "", (feature,), branch=("l_returnflag", "R"))
    rows = vectors.feature_rows(star.lines_of_customers(t), KEY, component, feature, LINE_ORDER)
    order = [*LINE_ORDER, "value", "right", "mask"]
    packed = vectors.pack_vectors(_layout(t), rows, KEY, ["value", "right", "mask"], order, size=CHUNK)
    return packed.select(
        "app_index", "chunk", *[_cents(name) for name in ("value", "right", "mask")]
    )


@query
def pack_width(t):
    return vectors.shape(t("customer").select(KEY), star.events_of_customers(t), KEY)


@query
def flatten_vectors(t):
    packed, width = _packed(t, CHUNK)
    return vectors.flatten_vectors(packed, "value", width, size=CHUNK)


@query
def packed_moments(t):
    """Count, sum and sum of squares under the mask, from stored chunks; every slot has a row."""
    packed, _ = _packed(t, CHUNK)
    return vectors.packed_moments(packed, "value", 2)


@query
def packed_dot(t):
    packed, _ = _packed(t, CHUNK)
    return vectors.packed_dot(packed, "value", "hour", 2)


@query
def vector_manifest(t):
    """Element and present counts of every packed vector."""
    packed, _ = _packed(t)
    shape = vectors.shape(t("customer").select(KEY), _purchases(t), KEY)
    return vectors.manifest(packed, ["value", "hour", "mask"], shape)


@query
def array_dot(t):
    return t("embeddings").select(
        "vec_id", arrays.dot(F.col("embedding"), F.reverse("embedding")).alias("dot")
    )


@query
def array_moments(t):
    mask = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    plain = arrays.moments(F.col("embedding"), mask)
    gap = arrays.difference_moments(F.col("embedding"), F.reverse("embedding"), mask)
    rows = t("embeddings").select("vec_id", plain.alias("m"), gap.alias("d"))
    return rows.select(
        "vec_id",
        F.col("m.count").alias("count"),
        F.col("m.sum").alias("sum"),
        F.col("m.sum_squares").alias("sum_squares"),
        F.col("d.sum").alias("difference_sum"),
        F.col("d.sum_squares").alias("difference_sum_squares"),
    )


# --- checks ---------------------------------------------------------------------------------


@query
def key_quality(t):
    checks = {"customer": (t("customer"), KEY), "orders": (t("orders"), "o_custkey")}
    parts = [
        validate.key_quality(df, key).select(F.lit(name).alias("table_name"), "*")
        for name, (df, key) in checks.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def repeated_keys(t):
    return validate.repeated_keys(t("orders"), "o_custkey")


@query
def dense_index_check(t):
    good = validate.dense_index_check(_layout(t))
    gaps = validate.dense_index_check(t("orders").select(F.col("o_custkey").alias("app_index")))
    return good.select(F.lit("layout").alias("layout"), "*").unionByName(
        gaps.select(F.lit("orders").alias("layout"), "*")
    )


@query
def ordered_key_agreement(t):
    receiver = t("orders").select(F.col("o_custkey").alias("key")).distinct()
    sender = t("events").select(F.col("user_id").alias("key")).distinct()
    a = ordering.hashed_index(receiver, "key", SEED, "position")
    b = ordering.hashed_index(sender, "key", SEED, "position")
    c = ordering.hashed_index(receiver, "key", SEED + 1, "position")
    pairs = {"same": (a, a), "sets": (a, b), "orders": (a, c)}
    parts = [
        validate.ordered_key_agreement(left, right, "key", "position").select(
            F.lit(name).alias("pair"), "*"
        )
        for name, (left, right) in pairs.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def coverage_check(t):
    """Event features cover every slot; the same features without some slots do not."""
    layout = _layout(t)
    function = star.DECLARED[2]
    long = long_features(layout, star.HISTORY[function.table](t), function)
    partial = long.filter((F.col("operation") != "count") | (F.col("app_index") % 2 == 0))
    return validate.coverage_check(partial, layout.count())


@query
def layout_fingerprint(t):
    rows = _layout(t)
    return validate.layout_fingerprint(rows, "app_index", KEY)


@query
def layout_fingerprint_blocks(t):
    """The same check with small blocks, so that block hashes are hashed again."""
    return validate.layout_fingerprint(_layout(t), "app_index", KEY, block=100)


@query
def bundle_compatibility(t):
    layout = _layout(t)
    other = align.receiver_layout(t("customer").select(KEY), KEY, SEED + 1)
    return validate.bundle_compatibility({"orders": layout, "events": layout, "lines": other}, "app_index", KEY)


# --- model and stages -----------------------------------------------------------------------


def _trained(t) -> model.FoldResult:
    """Ten folds over the labelled documents; the models are a stage named by their data.

    Each feature comes with a 0/1 feature that tells whether it is missing.
    """
    rows, languages = encode.one_hot(
        labelled_documents(t), {"lang": ("de", "en", "es", "fr")}, True
    )
    rows = rows.withColumn("source_number", F.expr("try_cast(substring(source, 4) AS double)"))
    features = ["n_chars", "source_number", *languages]
    flags = {f"{c}_missing": F.col(f"`{c}`").isNull().cast("double") for c in features}
    rows, features = rows.withColumns(flags), [*features, *flags]
    return model.train_folds(
        rows, "doc_id", "target", features, FOLDS, stages=f"{shared_folder(rows.sparkSession)}/models"
    )


@query
def oof_predictions(t):
    return _trained(t).out_of_fold


@query
def oof_coverage(t):
    """The parts of the out-of-fold scores that do not depend on the model."""
    result = _trained(t)
    in_range = F.col("score").between(0.0, 1.0).alias("in_range")
    held_out = result.out_of_fold.select("doc_id", "label", "fold", in_range)
    return held_out.unionByName(
        result.scores.select("doc_id", in_range), allowMissingColumns=True
    )


@query
def fold_mean_scores(t):
    return _trained(t).scores


@query
def fold_importance(t):
    return _trained(t).importance


@query
def fold_importance_totals(t):
    """The part of the importances that does not depend on the model."""
    return model.total_importance(_trained(t).importance)


@query
def mean_of_given_scores(t):
    """The mean over folds, on scores that SQL can make as well."""
    given = [((F.col("n_chars") * (i + 3)) % 101 / F.lit(128.0)).alias(f"s{i}") for i in range(FOLDS)]
    scored = t("documents").select("doc_id", *given)
    return scored.select("doc_id", model.mean_of([f"s{i}" for i in range(FOLDS)]).alias("score"))


# --- sources and sinks ----------------------------------------------------------------------


def _new_path(t) -> str:
    return f"{shared_folder(t('customer').sparkSession)}/sink-{uuid.uuid4().hex}"


@query
def csv_typed_scan(t):
    """Customers written as CSV and read back with declared types, a subset in another order."""
    path = sinks.write_new(t("customer"), _new_path(t), "csv")
    schema = "c_acctbal double, c_custkey long, c_mktsegment string"
    return read_csv(t("customer").sparkSession, path, schema)


@query
def csv_text_scan(t):
    """Orders written as CSV and read back as strings."""
    kept = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return read_csv_text(kept.sparkSession, sinks.write_new(kept, _new_path(t), "csv"))


@query
def json_sink(t):
    kept = t("customer").select(KEY, "c_nationkey", "c_mktsegment")
    path = sinks.write_new(kept, _new_path(t), "json")
    return kept.sparkSession.read.schema(kept.schema).json(path)


@query
def sink_keeps_what_is_there(t):
    """A second write to a folder is refused and leaves the first one's rows."""
    path = sinks.write_new(t("customer").select(KEY), _new_path(t))
    try:
        sinks.write_new(t("orders").select("o_orderkey"), path)
        refused = False
    except AnalysisException:
        refused = True
    kept = t("customer").sparkSession.read.parquet(path)
    return kept.select(KEY, F.lit(refused).alias("refused"))


@query
def submission_sink(t):
    scores = t("customer").select(KEY, F.col("c_nationkey").alias("score"))
    path = _new_path(t)
    sinks.write_submission(scores, path, KEY, "score")
    return read_csv(scores.sparkSession, path, f"{KEY} long, TARGET int")


@query
def vector_sink(t):
    """Flat cells written in position order; the elements found and the cells read back."""
    cells = t("customer").select((F.col(KEY) - 1).alias("position"), F.col("c_nationkey").cast("double").alias("value"))
    path = _new_path(t)
    elements = sinks.write_vector(cells, path)
    found = read_csv(cells.sparkSession, path, "value double")
    return found.select("value", F.lit(elements).cast("bigint").alias("elements"))


@query
def model_features(t):
    """Feature columns of a table without its identifiers, found by name, and dropped columns."""
    df = t("lineitem").drop("l_shipdate", "l_returnflag")
    require_columns(df, ["l_orderkey", "l_partkey"], "lines")
    names = feature_columns(df, ("l_orderkey", "l_partkey", "l_suppkey"))
    return df.select(*names)


@query
def function_by_name(t):
    """A declared function looked up by its name in another case, and run."""
    return aggregate_history(_orders(t), find_function((PRICE_FUNCTION,), PRICE_FUNCTION.name.upper()))


def _stages(
    spark: SparkSession, made: dict[str, Callable[[], DataFrame]], seal: dict | None = None
) -> dict[str, str]:
    """Write stages into the shared folder; their paths by name."""
    base = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    paths = {name: f"{base}/{name}" for name in made}
    for name, make in made.items():
        stage.resume_stage(spark, paths[name], name, make, seal)
    return paths


def stage_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Three stages written, checked against their completion records and listed."""
    t = star.tables(spark, folder)
    paths = _stages(
        spark,
        {
            "prices": lambda: aggregate_history(_orders(t), PRICE_FUNCTION),
            "events": lambda: star.event_features(t),
            "layout": lambda: _layout(t),
        },
    )
    for path in paths.values():
        stage.load_stage(spark, path)
    return stage.stage_summary(spark, paths).select("stage", "rows")


def _outputs_of(spark: SparkSession, function) -> DataFrame:
    """The outputs a declared function is to have."""
    listed = [(c.id, f.name, operation) for c, f, operation, _ in function.outputs()]
    return spark.createDataFrame(listed, "component_id string, feature string, operation string")


def _declared_stages(spark: SparkSession, folder: str) -> tuple[dict, dict, dict]:
    """Two declared functions as sealed stages: paths, makers and intended outputs."""
    t = star.tables(spark, folder)
    layout = _layout(t)
    chosen = {f.name: f for f in (star.DECLARED[0], star.DECLARED[2])}
    made = {
        name: lambda f=function: long_features(layout, star.HISTORY[f.table](t), f)
        for name, function in chosen.items()
    }
    paths = _stages(spark, made, stage.layout_seal(layout, "app_index", KEY))
    return paths, made, {name: _outputs_of(spark, f) for name, f in chosen.items()}


def stage_finalise(spark: SparkSession, folder: str) -> DataFrame:
    """Long features of two functions as stages, then checked and put together."""
    paths, _, expected = _declared_stages(spark, folder)
    return stage.finalise(spark, paths, expected=expected)


def stage_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The same stages asked for again: each is loaded, not built, and has its rows."""
    paths, made, _ = _declared_stages(spark, folder)
    parts = []
    for name, make in made.items():
        table, loaded = stage.resume_stage(spark, paths[name], name, make)
        counted = table.agg(F.count(F.lit(1)).alias("rows"))
        parts.append(counted.select(F.lit(name).alias("stage"), F.lit(loaded).alias("loaded"), "rows"))
    return parts[0].unionByName(parts[1])


QUERIES["stage_summary"] = stage_summary
QUERIES["stage_finalise"] = stage_finalise
QUERIES["stage_resume"] = stage_resume
