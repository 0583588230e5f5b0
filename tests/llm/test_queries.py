"""The registered queries and the pipeline, on whole small tables."""

import os
import re

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from entityloom.llm import simhash
from entityloom.llm.queries import ORACLE_SQL, QUERIES
from oracle.check import compare, connect
from tests.llm.conftest import table
from tests.llm.test_similarity import brute_hits, brute_removal, joined

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(n) for n in range(1, 14)}
    assert set(ORACLE_SQL) <= set(oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    result = compare(spark, connect(FOLDER), name, FOLDER)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op3_packing"}))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = QUERIES[name](spark, FOLDER)
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def pipeline_rows():
    rng = np.random.default_rng(8)
    clean = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 70)) for _ in range(30)]
    shared = " ".join(f"shared{i}" for i in range(55))
    item = " ".join(f"bench{i}" for i in range(12))
    rows = [(i, t, "en") for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en"), (101, clean[3], "fr"), (102, clean[4].upper(), "en")]
    rows += [(110, "a start " + shared, "en"), (111, shared + " b end c", "en"), (112, shared, "en")]
    rows += [(120, clean[5] + " x " + item, "en"), (121, item, "en")]
    rows += [(130, None, "en"), (131, "12 !!", "en"), (None, "no id " + clean[6][::-1], "en"), (None, clean[7], "en")]
    return rows, [(1, item), (2, None)]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = pipeline_rows()
    folder = str(tmp_path)
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/out{number}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(r.text for r in seen["language_id"]) == sorted(t for _, t, _ in kept)

    prints = [simhash.simhash(t) for _, t, _ in kept]
    roots = joined((a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 3)
    best = {}
    for (d, t, lang), f in zip(kept, prints, strict=True):
        if roots[f] not in best or (d is not None and (best[roots[f]][0] is None or d < best[roots[f]][0])):
            best[roots[f]] = (d, t, lang)
    kept = list(best.values())
    assert sorted(r.text for r in seen["near_duplicates"]) == sorted(t for _, t, _ in kept)

    after = {d: (n, k) for d, n, k in brute_removal(kept, 50)}
    kept = [(d, t if after[d or -1][0] == len(after[d or -1][1].split()) else after[d or -1][1], x) for d, t, x in kept]
    kept = [r for r in kept if r[1]]
    assert sorted(r.text for r in seen["substring_dedup"]) == sorted(t for _, t, _ in kept)
    assert {r.doc_id: r.text for r in seen["substring_dedup"]}[111] == "b end c"
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"])

    kept = [r for r in kept if not brute_hits(r[1], items)[1]]
    assert sorted(r.text for r in seen["decontamination"]) == sorted(t for _, t, _ in kept)
    assert {r.doc_id for r in seen["packing"]} == {d for d, _, _ in kept}
    whole = corpus_pipeline.run(spark, folder).collect()
    place = lambda r: (r.doc_id or -1, r.start, r.length, bytes(r.ids))
    assert sorted(map(place, whole)) == sorted(map(place, seen["packing"]))


def test_pipeline_over_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def words(seed, n=70):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_unlike_texts_of_one_id_both_stay(spark):
    a, b = words(1), words(2)
    rows = [(7, a, "en"), (7, b, "en"), (7, a, "de"), (8, a, "en"), (None, a, "en"), (None, words(3), "en"), (5, b + " x", "en")]
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "").collect()
    found = sorted((r.doc_id or -1, r.text) for r in kept)
    linked = (simhash.simhash(b) ^ simhash.simhash(b + " x")).bit_count() <= 3
    expected = [(7, a), (-1, words(3)), (5, b + " x")] + ([] if linked else [(7, b)])
    assert found == sorted(expected)


def test_stages_take_any_other_column_names(spark, tmp_path):
    docs = table(spark, [(1, words(1), "en"), (2, words(1) + " and " + words(2), "en"), (3, None, None), (3, "", "en")])
    for name in ("_removed", "_found_blocks", corpus_pipeline.ROW, "_language", "extra_0", "hash", "hashed", "row_hash"):
        docs = docs.withColumn(name, docs["doc_id"])
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
    assert {r["_removed"] for r in docs.collect()} == {1, 2}


def test_the_identified_language_is_kept(spark):
    english, german = words(1).replace("w", "the "), words(2).replace("w", "der ü ")
    rows = [(i, f"{english} {i}", "en") for i in range(40)] + [(100 + i, f"{german} {i}", "de") for i in range(40)]
    rows += [(500, english, None), (501, german, None), (502, "12 34", "en")]
    found = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, table(spark, rows), "").collect()}
    assert (found[500], found[501]) == ("en", "de") and 502 not in found
