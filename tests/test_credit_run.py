"""The whole credit run on small generated CSV files."""

import random

from entityloom.plans import credit, credit_run
from tests.helpers import rows


def write_csv(path, header, data):
    lines = [",".join(header), *[",".join("" if v is None else str(v) for v in row) for row in data]]
    path.write_text("\n".join(lines) + "\n")


def make_tables(folder, people=60):
    rng = random.Random(5)
    amount = lambda: round(rng.uniform(1, 100), 2)
    application = ["SK_ID_CURR", "TARGET", *credit.BINARY_COLUMNS, "NAME_TYPE", "DAYS_EMPLOYED", "DAYS_BIRTH"]
    application += ["AMT_INCOME_TOTAL", "AMT_CREDIT", "CNT_FAM_MEMBERS", "AMT_ANNUITY"]

    def person(key):
        flags = [rng.choice("MF"), rng.choice("YN"), rng.choice("YN")]
        numbers = [rng.choice([-10, 365243]), -1000, amount(), amount(), rng.randrange(3), amount()]
        return [key, *flags, rng.choice(["Cash", "Loan"]), *numbers]

    train = [person(k) for k in range(people)]
    write_csv(folder / "application_train.csv", application, [[r[0], r[0] % 2, *r[1:]] for r in train])
    test = [person(k) for k in range(people, people + 15)]
    write_csv(folder / "application_test.csv", [c for c in application if c != "TARGET"], test)
    keys = range(people + 15)
    numeric = [c for c in credit.BUREAU_NUMERIC if not c.startswith("MONTHS_")]
    loans = [[k, k * 10 + i, rng.choice(["Active", "Closed"]), *[amount() for _ in numeric]] for k in keys for i in range(k % 4)]
    write_csv(folder / "bureau.csv", ["SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", *numeric], loans)
    months = [[loan[1], -m, rng.choice("CX0")] for loan in loans for m in range(loan[1] % 3)]
    write_csv(folder / "bureau_balance.csv", ["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"], months)
    numeric = [c for c in credit.PREVIOUS_NUMERIC if c != "APP_CREDIT_PERC"]
    past = [[k, rng.choice(["Approved", "Refused"]), *[amount() for _ in numeric]] for k in keys for _ in range(k % 3)]
    write_csv(folder / "previous_application.csv", ["SK_ID_CURR", "NAME_CONTRACT_STATUS", *numeric], past)
    pos = [[k, -m, rng.randrange(3), 0, "Active"] for k in keys for m in range(k % 2 + 1)]
    write_csv(folder / "POS_CASH_balance.csv", ["SK_ID_CURR", *credit.POS_NUMERIC, "NAME_CONTRACT_STATUS"], pos)
    paid = ["NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"]
    instalments = [[k, m % 2, -m, rng.choice([None, -m - 1]), amount(), amount() + 50 * (k % 2)] for k in keys for m in range(3)]
    write_csv(folder / "installments_payments.csv", ["SK_ID_CURR", *paid], instalments)
    cards = [[k, k, *[amount() for _ in credit.CARD_NUMERIC]] for k in keys if k % 5 == 0]
    write_csv(folder / "credit_card_balance.csv", ["SK_ID_CURR", "SK_ID_PREV", *credit.CARD_NUMERIC], cards)


def test_run(spark, tmp_path):
    make_tables(tmp_path)
    tables = credit_run.read_tables(spark, str(tmp_path))
    assert credit_run.read_tables(spark, str(tmp_path), 5)["bureau"].count() == 5
    made = credit_run.run(tables, str(tmp_path / "submission"), folds=2, trees=2, depth=2, least_rows=5, step=1.0)
    # application; bureau 27 x 3 + shares; previous 30 x 3 + shares; POS; instalments; card 20 x 5 + count
    expected = 18 + (81 + 3 + 4) + (90 + 3) + (7 + 2 + 1) + (25 + 1) + (100 + 1)
    assert made.features.count() == 75 and len(made.features.columns) == expected
    scored = rows(made.folds.out_of_fold, "SK_ID_CURR")
    assert [r["SK_ID_CURR"] for r in scored] == list(range(60))
    submission = rows(spark.read.option("header", True).csv(str(tmp_path / "submission")))
    assert sorted(int(r["SK_ID_CURR"]) for r in submission) == list(range(60, 75))
    assert set(submission[0]) == {"SK_ID_CURR", "TARGET"}
    auc = {r["fold"]: r["auc"] for r in rows(made.auc)}
    assert set(auc) == {None, 0, 1} and auc[None] > 0.7
    assert made.top_importance.select("feature").distinct().count() == 40
