"""The credit workload on tiny tables with known results."""

import pytest

from entityloom.operators import align, validate, vectors
from entityloom.plans import credit
from entityloom.plans.compile import long_features, sufficient_statistics
from entityloom.plans.spec import find_function
from tests.helpers import one, rows


def table(spark, columns, *data):
    names = [c.split()[0] for c in columns.split(", ")]
    assert all(len(row) == len(names) for row in data)
    return spark.createDataFrame(list(data), columns)


@pytest.fixture(scope="module")
def slots(spark):
    return table(
        spark, "app_index bigint, SK_ID_CURR bigint, TARGET int", (0, 101, 0), (1, 102, 1), (2, 103, 0)
    )


@pytest.fixture(scope="module")
def bureau(spark):
    names = [c for c in credit.BUREAU_NUMERIC if not c.startswith("MONTHS_")]
    columns = "SK_ID_CURR bigint, SK_ID_BUREAU bigint, CREDIT_ACTIVE string, " + ", ".join(
        f"{n} double" for n in names
    )

    def row(key, bureau_id, active, days, amount, annuity):
        values = {"DAYS_CREDIT": days, "AMT_CREDIT_SUM": amount, "AMT_ANNUITY": annuity}
        return (key, bureau_id, active, *[values.get(n, 1.0) for n in names])

    return table(
        spark,
        columns,
        row(101, 1001, "Active", -10.0, 100.0, 5.0),
        row(101, 1002, "Closed", -20.0, 50.0, None),
        row(102, 1003, "Active", -5.0, 75.0, 4.0),
    )


@pytest.fixture(scope="module")
def balance(spark):
    return table(
        spark,
        "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string",
        (1001, -1, "C"),
        (1001, -2, "0"),
        (1002, -1, "C"),
        (1003, -1, None),
    )


@pytest.fixture(scope="module")
def previous(spark):
    names = [n for n in credit.PREVIOUS_NUMERIC if n != "APP_CREDIT_PERC"]
    columns = (
        "SK_ID_CURR bigint, NAME_CONTRACT_STATUS string, "
        + ", ".join(f"{n} double" for n in names)
        + ", DAYS_FIRST_DUE double"
    )

    def row(key, status, asked, given):
        values = {"AMT_APPLICATION": asked, "AMT_CREDIT": given}
        return (key, status, *[values.get(n, 2.0) for n in names], 365243.0)

    return table(
        spark,
        columns,
        row(101, "Approved", 80.0, 100.0),
        row(101, "Refused", 50.0, 100.0),
        row(102, "Approved", 90.0, 100.0),
    )


@pytest.fixture(scope="module")
def pos(spark):
    return table(
        spark,
        "SK_ID_CURR bigint, MONTHS_BALANCE int, SK_DPD int, SK_DPD_DEF int, NAME_CONTRACT_STATUS string",
        (101, -1, 0, 0, "Active"),
        (101, -2, 2, 0, "Signed"),
        (102, -1, 1, 1, None),
        (999, -1, 9, 9, "Active"),
    )


@pytest.fixture(scope="module")
def installments(spark):
    return table(
        spark,
        "SK_ID_CURR bigint, NUM_INSTALMENT_VERSION double, DAYS_INSTALMENT double,"
        " DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double".replace("  ", " "),
        (101, 1.0, -20.0, -10.0, 100.0, 80.0),
        (101, 2.0, -5.0, -10.0, 50.0, 60.0),
        (102, 1.0, -5.0, -5.0, 25.0, 25.0),
        (102, None, -5.0, None, 25.0, None),
    )


@pytest.fixture(scope="module")
def card(spark):
    columns = "SK_ID_CURR bigint, SK_ID_PREV bigint, NAME_CONTRACT_STATUS string, " + ", ".join(
        f"{n} double" for n in credit.CARD_NUMERIC
    )

    def row(key, prev, value):
        return (key, prev, "Active", *[value] * len(credit.CARD_NUMERIC))

    return table(spark, columns, row(101, 1, 10.0), row(101, 2, 20.0), row(102, 3, 5.0))


def declared(slots, history, name):
    function = find_function(credit.DECLARED_FUNCTIONS, name)
    found = rows(long_features(slots, history, function))
    return {(r["component_id"], r["app_index"], r["feature"], r["operation"]): r["value"] for r in found}


def test_thirteen_components_and_their_outputs():
    parts = [c for f in credit.DECLARED_FUNCTIONS for c in f.components]
    assert len(credit.DECLARED_FUNCTIONS) == 5
    assert len(parts) == len({c.id for c in parts}) == 13
    assert sum(len(f.outputs()) for f in credit.DECLARED_FUNCTIONS) == 17 * 3 + 12 * 3 + 4 + 17 + 61


def test_unknown_function_is_refused():
    with pytest.raises(ValueError, match="not among the declared functions"):
        find_function(credit.DECLARED_FUNCTIONS, "nothing")
    assert find_function(credit.DECLARED_FUNCTIONS, "BUREAU").name == "bureau"


def test_declared_bureau(slots, bureau, balance):
    value = declared(slots, credit.with_balance_size(bureau, balance), "bureau")
    assert value["B01", 0, "DAYS_CREDIT", "mean"] == -15.0
    assert value["B01", 0, "DAYS_CREDIT", "var"] == 50.0
    assert value["B01", 0, "MONTHS_BALANCE_SIZE", "sum"] == 3.0
    assert value["B02", 0, "AMT_CREDIT_SUM", "sum"] == 100.0
    assert value["B03", 0, "AMT_CREDIT_SUM", "sum"] == 50.0
    assert value["B03", 1, "AMT_CREDIT_SUM", "sum"] == 0.0
    assert value["B03", 1, "AMT_CREDIT_SUM", "mean"] is None
    assert value["B01", 2, "AMT_CREDIT_SUM", "sum"] == 0.0
    assert value["B01", 1, "DAYS_CREDIT", "var"] is None


def test_declared_previous(slots, previous):
    value = declared(slots, previous, "previous")
    assert value["P02", 0, "APP_CREDIT_PERC", "mean"] == pytest.approx(0.8)
    assert value["P03", 0, "APP_CREDIT_PERC", "mean"] == pytest.approx(0.5)
    assert value["P01", 0, "APP_CREDIT_PERC", "var"] == pytest.approx(0.045)


def test_declared_counts_ignore_unknown_keys(slots, pos):
    value = declared(slots, pos, "pos")
    assert [value["POS01", i, "ROW_COUNT", "count"] for i in range(3)] == [2.0, 1.0, 0.0]
    assert value["POS02", 0, "SK_DPD", "mean"] == 1.0


def test_declared_installments(slots, installments):
    value = declared(slots, installments, "installments")
    assert value["I03", 0, "PAYMENT_DIFF", "sum"] == 10.0
    assert value["I03", 0, "PAYMENT_DIFF", "var"] == 450.0
    assert value["I02", 0, "DPD", "sum"] == 10.0
    assert value["I02", 1, "DPD", "mean"] == 0.0
    assert value["I01", 1, "ROW_COUNT", "count"] == 2.0


def test_declared_statistics(slots, installments, card):
    function = find_function(credit.DECLARED_FUNCTIONS, "installments")
    stats = {
        (r["component_id"], r["app_index"], r["feature"]): (r["count"], r["sum"], r["sum_squares"])
        for r in rows(sufficient_statistics(slots, installments, function))
    }
    assert stats["I03", 0, "PAYMENT_DIFF"] == (2.0, 10.0, 500.0)
    assert stats["I03", 1, "PAYMENT_DIFF"] == (1.0, 0.0, 0.0)
    assert stats["I01", 2, "ROW_COUNT"] == (0.0, 0.0, 0.0)


def test_feature_vectors(slots, bureau, installments):
    def packed(history, function, component, feature, order, size=8192):
        spec = find_function(credit.DECLARED_FUNCTIONS, function)
        part = next(c for c in spec.components if c.id == component)
        wanted = next(f for f in part.features if f.name == feature)
        made = vectors.feature_rows(history, credit.KEY, part, wanted, order)
        names = [c for c in made.columns if c in ("value", "right", "mask")]
        stored = vectors.pack_vectors(slots, made, credit.KEY, names, order, size=size)
        # Only present cells are stored; the zeros up to the width are written out to be seen.
        return rows(vectors.padded(stored, names, vectors.pack_width(made, credit.KEY), size), "app_index")

    first, _, third = packed(installments, "installments", "I03", "PAYMENT_DIFF", ["DAYS_INSTALMENT"])
    assert (first["value"], first["right"], first["mask"]) == ([100.0, 50.0], [80.0, 60.0], [1.0, 1.0])
    assert third["value"] == third["right"] == third["mask"] == [0.0, 0.0]
    active = packed(bureau, "bureau", "B02", "DAYS_CREDIT", ["SK_ID_BUREAU"])
    assert active[0]["value"] == [-10.0, -20.0] and active[0]["mask"] == [1.0, 0.0]
    annuity = packed(bureau, "bureau", "B01", "AMT_ANNUITY", ["SK_ID_BUREAU"])
    assert [r["value"] for r in annuity] == [[5.0], [4.0], [0.0]], "missing values are left out"


def test_blank_slot_is_a_slot_without_history(spark, pos):
    layout = spark.createDataFrame([(0, None), (1, 102)], "app_index bigint, SK_ID_CURR bigint")
    value = declared(layout, pos, "pos")
    assert value["POS01", 0, "ROW_COUNT", "count"] == 0.0
    assert value["POS01", 1, "ROW_COUNT", "count"] == 1.0


def test_aligned_layout_feeds_a_function(spark, pos):
    receivers = spark.createDataFrame([("101", 0), ("102", 1), ("103", 0)], "SK_ID_CURR string, TARGET int")
    senders = spark.createDataFrame([("102",), ("103",)], "SK_ID_CURR string")
    layout = align.receiver_layout(receivers, "SK_ID_CURR", 7)
    shown = align.aligned_layout(layout, senders, "SK_ID_CURR")
    assert shown.columns == ["app_index", "SK_ID_CURR"]
    found = rows(shown, "app_index")
    assert [r["app_index"] for r in found] == [0, 1, 2]
    assert sorted(r["SK_ID_CURR"] for r in found if r["SK_ID_CURR"]) == ["102", "103"]
    history = spark.createDataFrame(
        [("102", -1, 2, 0), ("103", -2, 0, 0)],
        "SK_ID_CURR string, MONTHS_BALANCE int, SK_DPD int, SK_DPD_DEF int",
    )
    value = declared(shown, history, "pos")
    counts = [v for (_, _, f, op), v in value.items() if op == "count"]
    assert sorted(counts) == [0.0, 1.0, 1.0]
    totals = one(align.alignment_counts(layout, senders, "SK_ID_CURR"))
    assert totals == {"dense_slots": 3, "intersection": 2, "receiver_unmatched": 1}


def test_bureau_features(bureau, balance):
    found = {r["SK_ID_CURR"]: r for r in rows(credit.bureau_features(bureau, balance))}
    first = found[101]
    assert first["BURO_DAYS_CREDIT_MEAN"] == -15.0
    assert first["BURO_DAYS_CREDIT_VAR"] == pytest.approx(50.0)
    assert first["ACTIVE_AMT_CREDIT_SUM_SUM"] == 100.0
    assert first["CLOSED_AMT_ANNUITY_MAX"] is None
    assert first["BURO_AMT_ANNUITY_MEAN"] == 5.0
    assert first["BURO_MONTHS_BALANCE_SIZE_SUM"] == 3.0
    assert first["BURO_MONTHS_BALANCE_MIN_MIN"] == -2.0
    assert first["BURO_CREDIT_ACTIVE_Active_MEAN"] == 0.5
    assert first["BURO_CREDIT_ACTIVE_nan_MEAN"] == 0.0
    assert first["BURO_STATUS_C_MEAN_MEAN"] == 0.75
    second = found[102]
    assert second["BURO_STATUS_nan_MEAN_MEAN"] == 1.0
    assert second["CLOSED_AMT_CREDIT_SUM_SUM"] is None, "a branch without rows has no sum"
    assert len(first) == 1 + 27 * 3 + 3 + 3


def test_installment_features_count_a_missing_delay_as_zero(installments):
    found = {r["SK_ID_CURR"]: r for r in rows(credit.installment_features(installments))}
    assert found[102]["INSTAL_DPD_MEAN"] == 0.0
    assert found[102]["INSTAL_NUM_INSTALMENT_VERSION_NUNIQUE"] == 1
    assert found[102]["INSTAL_COUNT"] == 2
    assert found[101]["INSTAL_PAYMENT_DIFF_VAR"] == pytest.approx(450.0)
    assert found[101]["INSTAL_PAYMENT_PERC_MAX"] == pytest.approx(1.2)


def test_card_features_cover_every_column(card):
    found = {r["SK_ID_CURR"]: r for r in rows(credit.card_features(card))}
    assert found[101]["CC_AMT_BALANCE_SUM"] == 30.0
    assert found[101]["CC_AMT_BALANCE_VAR"] == pytest.approx(50.0)
    assert found[102]["CC_AMT_BALANCE_VAR"] is None
    assert found[101]["CC_NAME_CONTRACT_STATUS_nan_MAX"] == 0
    assert found[101]["CC_COUNT"] == 2
    assert not any("SK_ID_PREV" in name for name in found[101])


def applications(spark):
    columns = (
        "SK_ID_CURR bigint, TARGET int, CODE_GENDER string, FLAG_OWN_CAR string, FLAG_OWN_REALTY string,"
        " NAME_TYPE string, DAYS_EMPLOYED double, DAYS_BIRTH double, AMT_INCOME_TOTAL double,"
        " AMT_CREDIT double, CNT_FAM_MEMBERS double, AMT_ANNUITY double"
    )
    train = spark.createDataFrame(
        [
            (101, 0, "M", "Y", "N", "Cash", -100.0, -1000.0, 10.0, 100.0, 2.0, 5.0),
            (102, 1, "F", "N", "N", "Cash", 365243.0, -1000.0, 20.0, 100.0, 0.0, 5.0),
            (104, 1, "XNA", "N", "N", "Cash", -1.0, -1000.0, 20.0, 100.0, 1.0, 5.0),
        ],
        columns,
    )
    test = spark.createDataFrame(
        [(103, None, None, "Y", "Y", None, -50.0, -500.0, 30.0, 300.0, 3.0, 6.0)], columns
    ).drop("TARGET")
    return train, test


def test_application_features(spark):
    found = {r["SK_ID_CURR"]: r for r in rows(credit.application_features(*applications(spark)))}
    assert sorted(found) == [101, 102, 103], "XNA is dropped, a missing gender is kept"
    assert [found[k]["CODE_GENDER"] for k in (101, 102, 103)] == [0, 1, -1]
    assert [found[k]["FLAG_OWN_CAR"] for k in (101, 102, 103)] == [0, 1, 0]
    assert found[102]["DAYS_EMPLOYED"] is None and found[102]["DAYS_EMPLOYED_PERC"] is None
    assert found[102]["INCOME_PER_PERSON"] is None, "division by zero is missing"
    assert found[101]["DAYS_EMPLOYED_PERC"] == 0.1
    assert found[103]["TARGET"] is None
    assert found[103]["NAME_TYPE_Cash"] == 0 and "NAME_TYPE_nan" not in found[103]


def test_feature_table(spark, bureau, balance, previous, pos, installments, card):
    train, test = applications(spark)
    wide = credit.feature_table(
        {
            "application_train": train,
            "application_test": test,
            "bureau": bureau,
            "bureau_balance": balance,
            "previous_application": previous,
            "POS_CASH_balance": pos,
            "installments_payments": installments,
            "credit_card_balance": card,
        }
    )
    found = {r["SK_ID_CURR"]: r for r in rows(wide)}
    assert sorted(found) == [101, 102, 103]
    assert found[101]["POS_MONTHS_BALANCE_SIZE"] == found[101]["POS_COUNT"] == 2
    assert found[101]["APPROVED_APP_CREDIT_PERC_MEAN"] == pytest.approx(0.8)
    assert found[103]["POS_COUNT"] is None and found[103]["BURO_AMT_CREDIT_SUM_SUM"] is None


def test_bundles_with_different_layouts_are_refused(spark):
    keys = spark.createDataFrame([(str(i),) for i in range(20)], "k string")
    a, b = align.receiver_layout(keys, "k", 1), align.receiver_layout(keys, "k", 2)
    validate.require_compatible({"x": a, "y": a}, "app_index", "k")
    with pytest.raises(ValueError, match="different slot layouts"):
        validate.require_compatible({"x": a, "y": b}, "app_index", "k")
