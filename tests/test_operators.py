"""Alignment, ordering, vectors, checks, stages, encoding, folds and models."""

import random

import pytest
from pyspark.sql import functions as F

from entityloom.operators import align, encode, model, ordering, stage, validate, vectors
from entityloom.session import materialise
from entityloom.sources import readers, sinks
from tests.helpers import one, rows


@pytest.fixture()
def skewed(spark):
    """A third of all rows belong to one key."""
    data = [("hot" if i % 3 == 0 else f"k{i % 17}", i, float(i % 11)) for i in range(900)]
    random.Random(3).shuffle(data)
    return spark.createDataFrame(data, "k string, i int, v double").repartition(5)


# --- key sets ---------------------------------------------------------------------------------


def test_distinct_keys_and_audit(spark):
    sender = spark.createDataFrame([(" 102",), ("102",), ("103",), ("999 ",)], "k string")
    assert sorted(r["k"] for r in rows(align.distinct_keys(sender, "k"))) == ["102", "103", "999"]
    assert one(align.key_audit(sender, "k")) == {
        "source_rows": 4,
        "unique_keys": 3,
        "duplicate_rows_removed": 1,
        "blank_rows": 0,
    }


def test_key_union(spark):
    a = spark.createDataFrame([("101",), ("101",), ("900",)], "k string")
    b = spark.createDataFrame([(102,), (900,), (901,)], "id bigint")
    sources = {"a": (a, "k"), "b": (b, "id")}
    assert sorted(r["key"] for r in rows(align.key_union(sources))) == ["101", "102", "900", "901"]
    audit = {r["source"]: r for r in rows(align.key_union_audit(sources))}
    assert audit["(union)"]["source_rows"] == 6
    assert audit["(union)"]["unique_keys"] == 4
    assert audit["(union)"]["duplicate_rows_removed"] == 2
    assert audit["a"]["duplicate_rows_removed"] == 1 and audit["b"]["duplicate_rows_removed"] == 0
    with pytest.raises(ValueError, match="no sender"):
        align.key_union({})


def test_key_quality(spark):
    df = spark.createDataFrame([("a",), ("a",), (" ",), (None,), ("b",)], "k string")
    assert one(validate.key_quality(df, "k")) == {
        "rows": 5,
        "blank_rows": 2,
        "unique_keys": 2,
        "repeated_keys": 1,
        "valid": False,
    }
    assert rows(validate.repeated_keys(df, "k")) == [{"key": "a", "rows": 2}]
    with pytest.raises(ValueError, match="1 repeated"):
        validate.require_unique_keys(df, "k")
    assert validate.require_unique_keys(df.filter("k = 'b'"), "k").count() == 1


def test_ordered_key_agreement(spark):
    make = lambda *keys: spark.createDataFrame(
        [(k, i) for i, k in enumerate(keys)], "k string, p int"
    )
    assert validate.require_agreement(make("101", "102"), make("101", "102"), "k", "p") == 2
    with pytest.raises(ValueError, match="different orders"):
        validate.require_agreement(make("101", "102"), make("102", "101"), "k", "p")
    with pytest.raises(ValueError, match="sets differ: left_only=1, right_only=2"):
        validate.require_agreement(make("101", "102"), make("102", "103", "104"), "k", "p")


def test_probe_counts_and_children(spark, skewed):
    entities = spark.createDataFrame([("hot",), ("k1",), ("absent",)], "k string")
    counters = one(align.scan_counters(skewed, entities, "k"))
    hot = skewed.filter("k = 'hot'").count()
    k1 = skewed.filter("k = 'k1'").count()
    assert counters == {
        "rows_scanned": 900,
        "rows_matched": hot + k1,
        "entities": 3,
        "entities_matched": 2,
        "entities_unmatched": 1,
    }
    assert align.probe(skewed, entities, "k").count() == hot + k1
    counts = {r["k"]: r["child_rows"] for r in rows(align.restricted_child_count(skewed, entities, "k"))}
    assert counts == {"hot": hot, "k1": k1, "absent": 0}


# --- ordering ---------------------------------------------------------------------------------


def test_hashed_index_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    one_way = {r["k"]: r["app_index"] for r in rows(ordering.hashed_index(df, "k", 7))}
    again = {r["k"]: r["app_index"] for r in rows(ordering.hashed_index(df.repartition(7), "k", 7))}
    other = {r["k"]: r["app_index"] for r in rows(ordering.hashed_index(df, "k", 8))}
    assert sorted(one_way.values()) == list(range(500))
    assert one_way == again and one_way != other
    assert one(validate.dense_index_check(ordering.hashed_index(df, "k", 7)))["dense"] is True


def test_dense_index_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit("x").alias("payload"))
    found = rows(ordering.dense_index(df.repartition(6), ["k"]), "k")
    assert [r["app_index"] for r in found] == list(range(1000))
    assert found[3] == {"k": 3, "payload": "x", "app_index": 3}


def test_dense_index_check_finds_gaps(spark):
    for values, dense in (([0, 1, 2], True), ([0, 2], False), ([1, 2], False), ([0, 0, 1], False), ([], False)):
        df = spark.createDataFrame([(v,) for v in values], "app_index int")
        assert one(validate.dense_index_check(df))["dense"] is dense


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(200)], "o int, v int").repartition(5)
    found = rows(ordering.running_totals(df, ["o"], {"before": "v"}), "o")
    assert [r["before"] for r in found] == [i * (i - 1) for i in range(200)]


def test_slot_positions_split_a_large_group(spark, skewed):
    split = rows(ordering.slot_positions(skewed, "k", ["i"]), "k", "i")
    assert [r["slot"] for r in split if r["k"] == "hot"] == list(range(300))
    nameless = skewed.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    assert [r["slot"] for r in rows(ordering.slot_positions(nameless, "k", ["i"]), "i") if r["k"] is None] == list(
        range(300)
    )


def test_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    sizes = [r["count"] for r in rows(ordering.kfold(df, "id", 10).groupBy("fold").count(), "fold")]
    assert sorted(sizes) == [10] * 7 + [11] * 3 and len(sizes) == 10
    strata = rows(ordering.stratified_kfold(df, "id", "y", 5).groupBy("y", "fold").count(), "y", "fold")
    assert len(strata) == 10
    for y in (0, 1):
        counts = [r["count"] for r in strata if r["y"] == y]
        assert max(counts) - min(counts) <= 1
    missing = df.withColumn("y", F.when(F.col("id") > 50, F.col("y")))
    assert ordering.stratified_kfold(missing, "id", "y", 5).count() == 103


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_roc_auc(spark):
    rng = random.Random(1)
    data = [(i, rng.randrange(2), rng.randrange(12) / 4, i % 3) for i in range(300)]
    df = spark.createDataFrame(data, "i int, y int, s double, fold int").repartition(4)
    found = {r["fold"]: r["auc"] for r in rows(ordering.roc_auc(df, "y", "s", "fold"))}
    for fold in range(3):
        assert found[fold] == pytest.approx(brute_auc([(s, y) for _, y, s, f in data if f == fold]))
    whole = brute_auc([(s, y) for _, y, s, _ in data])
    assert found[None] == pytest.approx(whole)
    assert one(ordering.roc_auc(df, "y", "s"))["auc"] == found[None]
    turned = df.withColumn("s", -F.col("s"))
    assert one(ordering.roc_auc(turned, "y", "s"))["auc"] == pytest.approx(1 - whole)
    flat = df.withColumn("s", F.lit(0.3))
    assert one(ordering.roc_auc(flat, "y", "s"))["auc"] == 0.5


def test_top_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.5), ("c", 9.0), ("d", 2.0)], "f string, w double")
    assert sorted(r["f"] for r in rows(ordering.top_groups(df, "f", "w", 2))) == ["b", "c"]
    assert sorted(r["f"] for r in rows(ordering.top_groups(df, "f", "w", 3))) == ["a", "a", "b", "c"]


# --- vectors ----------------------------------------------------------------------------------


def test_pack_counts_and_padding(spark):
    slots = spark.createDataFrame([(0, 101), (1, 102), (2, 103)], "app_index int, k int")
    history = spark.createDataFrame([(101, 0), (102, 1), (101, 2), (999, 3)], "k int, o int")
    matched = align.probe(history, slots, "k")
    width = vectors.pack_width(matched, "k")
    assert width == 2
    packed = vectors.pack_vectors(slots, matched.select("k", "o"), "k", ["o"], ["o"])
    flat = rows(vectors.flatten_vectors(packed, "o", width), "position")
    assert [(r["position"], r["value"]) for r in flat] == [(0, 0.0), (1, 2.0), (2, 1.0)]
    shape = vectors.shape(slots, history, "k")
    assert one(shape) == {"slots": 3, "width": 2, "matched": 3, "padding": 3}
    listed = {r["vector"]: r for r in rows(vectors.manifest(packed, ["o", "mask"], shape))}
    assert listed["mask"] == {"vector": "mask", "elements": 6, "present": 3} and len(listed) == 2
    nothing = vectors.shape(slots, history.limit(0), "k")
    assert one(nothing) == {"slots": 3, "width": 1, "matched": 0, "padding": 3}


@pytest.mark.parametrize("size", [7, 64, 8192])
def test_pack_stores_present_cells_only(spark, skewed, size):
    slots = ordering.hashed_index(skewed.select("k").distinct(), "k", 1)
    width = vectors.pack_width(skewed, "k")
    packed = vectors.pack_vectors(slots, skewed, "k", ["v"], ["i"], size=size)
    assert packed.agg(F.max(F.size("v"))).first()[0] <= size
    assert packed.agg(F.sum(F.size("v"))).first()[0] == skewed.count()
    flat = {r["position"]: r["value"] for r in rows(vectors.flatten_vectors(packed, "v", width, size=size))}
    index = {r["k"]: r["app_index"] for r in rows(slots)}
    expected, seen = {}, dict.fromkeys(index, 0)
    for r in rows(skewed, "i"):
        expected[index[r["k"]] * width + seen[r["k"]]] = r["v"]
        seen[r["k"]] += 1
    assert flat == expected


@pytest.mark.parametrize("size", [3, 8192])
def test_sparse_chunks_equal_dense_vectors(spark, size):
    slots = spark.createDataFrame([(0, 101), (1, 102), (2, 103), (3, None)], "app_index int, k int")
    lines = [(101, i, 1.5 * i, 2.0 * i - 3, float(i % 2)) for i in range(8)] + [(102, 0, -4.25, 2.0, 1.0)]
    history = spark.createDataFrame([*lines, (999, 0, 1.0, 1.0, 1.0)], "k int, o int, v double, w double, mask double")
    packed = vectors.pack_vectors(slots, history, "k", ["v", "w", "mask"], ["o"], size=size)
    assert packed.filter("app_index >= 2 AND chunk = 0 AND size(v) = 0").count() == 2
    width = 8
    dense = {i: ([0.0] * width, [0.0] * width, [0.0] * width) for i in range(4)}
    for r in rows(vectors.padded(packed, ["v", "w", "mask"], width, size)):
        assert len(r["v"]) == len(r["mask"]) == min(size, width - r["chunk"] * size)
        for column, name in zip(dense[r["app_index"]], ("v", "w", "mask"), strict=True):
            column[r["chunk"] * size : (r["chunk"] + 1) * size] = r[name]
    for scale in (None, 3):
        plain = {r["app_index"]: r for r in rows(vectors.packed_moments(packed, "v", scale))}
        gap = {r["app_index"]: r for r in rows(vectors.packed_moments(packed, "v", scale, right="w"))}
        dots = {r["app_index"]: r["dot"] for r in rows(vectors.packed_dot(packed, "v", "w", scale))}
        for i, (v, w, m) in dense.items():
            assert dots[i] == sum(a * b for a, b in zip(v, w, strict=True))
            for found, xs in ((plain[i], v), (gap[i], [a - b for a, b in zip(v, w, strict=True)])):
                kept = [x for x, y in zip(xs, m, strict=True) if y]
                assert (found["count"], found["sum"]) == (len(kept), sum(kept))
                assert found["sum_squares"] == sum(x * x for x in kept)


# --- checks -----------------------------------------------------------------------------------


def test_coverage(spark):
    cells = [("c", "f", op, i) for op in ("sum", "mean") for i in range(3)]
    full = spark.createDataFrame(cells, "component_id string, feature string, operation string, app_index int")
    assert all(r["complete"] for r in rows(validate.coverage_check(full, 3)))
    twice = full.unionByName(full.filter("operation = 'sum' AND app_index = 1"))
    assert {r["operation"]: r["complete"] for r in rows(validate.coverage_check(twice, 3))} == {
        "sum": False,
        "mean": True,
    }
    expected = spark.createDataFrame(
        [("c", "f", "sum"), ("c", "f", "var")], "component_id string, feature string, operation string"
    )
    found = {r["operation"]: r["complete"] for r in rows(validate.coverage_check(full, 3, expected))}
    assert found == {"sum": True, "mean": False, "var": False}


def test_layout_fingerprint(spark):
    import hashlib

    keys = [f"key-{i}" for i in range(250)]
    df = spark.createDataFrame(list(enumerate(keys)), "app_index int, k string").repartition(4)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    cells = [sha(f"{i}:={k}") for i, k in enumerate(keys)]

    def expected(block):
        level = cells
        for _ in range(2):
            level = [sha("".join(level[i : i + block])) for i in range(0, len(level), block)]
        return {"slots": 250, "fingerprint": sha("".join(level))}

    assert one(validate.layout_fingerprint(df, "app_index", "k")) == expected(65_536)
    assert one(validate.layout_fingerprint(df, "app_index", "k", block=10)) == expected(10)


@pytest.mark.parametrize(
    ("left", "right"),
    [
        ([(0, "a\nb"), (1, "c")], [(0, "a"), (1, "b\nc")]),
        ([(0, None), (1, "c")], [(0, ""), (1, "c")]),
        ([(0, "?")], [(0, None)]),
        ([(None, "a"), (1, "c")], [(0, "a"), (1, "c")]),
    ],
)
def test_layout_fingerprint_is_unambiguous(spark, left, right):
    prints = [
        one(validate.layout_fingerprint(spark.createDataFrame(x, "app_index int, k string"), "app_index", "k"))
        for x in (left, right)
    ]
    assert prints[0]["slots"] == prints[1]["slots"]
    assert prints[0]["fingerprint"] != prints[1]["fingerprint"]


def test_tolerance(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i int, x double")
    b = spark.createDataFrame([(0, 1.00005), (1, 2.0)], "i int, x double")
    details = validate.tolerance_compare(a, b, "i", "x")
    assert [r["passed"] for r in rows(details, "i")] == [True, True, False]
    summary = one(validate.tolerance_summary(details.filter("i < 2"), actual_rows=2))
    assert summary["checked_rows"] == 2 and summary["passed"] is True
    assert summary["max_absolute_error"] == pytest.approx(5e-5)
    assert one(validate.tolerance_summary(details))["passed"] is False


# --- encoding ---------------------------------------------------------------------------------


def test_one_hot_and_discovery(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", "x")], "i int, c string, d string")
    found = encode.discover_categories(df)
    assert found == {"c": ("a", "b"), "d": ("x",)}
    encoded, names = encode.one_hot(df, found, True)
    assert names == ["c_a", "c_b", "c_nan", "d_x", "d_nan"]
    assert rows(encoded, "i")[0] == {"i": 1, "c_a": 0, "c_b": 1, "c_nan": 0, "d_x": 0, "d_nan": 1}
    assert encode.one_hot(df, found, False)[1] == ["c_a", "c_b", "d_x"]


def test_discovery_has_no_limit(spark):
    found = encode.discover_categories(spark.range(5001).select(F.col("id").cast("string").alias("c")))
    assert len(found["c"]) == 5001


def test_label_encode_by_first_appearance(spark):
    data = [(1, "M"), (2, None), (3, "F"), (4, "M"), (5, "X"), (6, "F")]
    df = spark.createDataFrame(data, "i int, g string").repartition(3)
    assert [r["g"] for r in rows(encode.label_encode(df, ["g"], "i"), "i")] == [0, -1, 1, 0, 2, 1]


# --- stages, sources and sinks ----------------------------------------------------------------


def test_stage_is_written_resumed_and_checked(spark, tmp_path):
    path = str(tmp_path / "stage")
    built = []

    def make():
        built.append(1)
        return spark.range(10).withColumn("x", F.lit(1.5))

    with pytest.raises(FileNotFoundError):
        stage.load_stage(spark, path)
    first, loaded = stage.resume_stage(spark, path, "s", make)
    assert not loaded and first.count() == 10
    again, loaded = stage.resume_stage(spark, path, "s", make)
    assert loaded and again.count() == 10 and len(built) == 1
    with pytest.raises(FileExistsError):
        stage.write_stage(make(), path, "s")
    assert one(stage.stage_summary(spark, {"s": path}))["rows"] == 10
    data = stage.read_completion(spark, path)["data"]
    spark.range(9).withColumn("x", F.lit(1.5)).write.mode("overwrite").parquet(f"{path}/{data}")
    with pytest.raises(ValueError, match="does not match"):
        stage.resume_stage(spark, path, "s", make)


def test_finalise_checks_coverage_and_layout(spark, tmp_path):
    cells = [("c", "f", "sum", i, float(i)) for i in range(3)]
    outputs = "component_id string, feature string, operation string"
    full = spark.createDataFrame(cells, f"{outputs}, app_index int, value double")
    layouts = [
        spark.createDataFrame(list(enumerate(keys)), "app_index int, k string") for keys in ("abc", "bac", "abcd")
    ]
    seals = [stage.layout_seal(layout, "app_index", "k") for layout in layouts]

    def write(name, seal):
        path = str(tmp_path / name)
        stage.write_stage(full, path, name, seal)
        return path

    paths = {name: write(name, seals[0]) for name in ("a", "b")}
    assert stage.finalise(spark, paths).groupBy("function").count().count() == 2
    listed = spark.createDataFrame([("c", "f", "sum")], outputs)
    assert stage.finalise(spark, paths, expected={"a": listed, "b": listed}).count() == 6
    more = listed.union(spark.createDataFrame([("c", "f", "mean")], outputs))
    with pytest.raises(ValueError, match="stage b does not cover every slot for 1 outputs"):
        stage.finalise(spark, paths, expected={"a": listed, "b": more})
    with pytest.raises(ValueError, match="does not cover every slot for 1 outputs"):
        stage.finalise(spark, {"c": write("c", seals[2])})
    with pytest.raises(ValueError, match="different slot layouts"):
        stage.finalise(spark, paths | {"d": write("d", seals[1])})
    with pytest.raises(ValueError, match="another slot layout"):
        stage.resume_stage(spark, paths["a"], "a", lambda: full, seals[1])
    with pytest.raises(ValueError, match="name no slot layout"):
        stage.finalise(spark, {"e": write("e", None)})
    with pytest.raises(ValueError, match="at least one stage"):
        stage.finalise(spark, {})


def test_content_hash_sees_swapped_missing_values(spark):
    make = lambda *r: stage.content_fingerprint(spark.createDataFrame([r], "a int, b int"))
    assert make(1, None) != make(None, 1)
    assert make(1, 2) == make(1, 2)


def test_an_unfinished_attempt_is_not_a_stage(spark, tmp_path):
    path = str(tmp_path / "stage")
    spark.range(3).write.parquet(f"{path}/data-left-over")
    stored, loaded = stage.resume_stage(spark, path, "s", lambda: spark.range(4).toDF("id"))
    assert not loaded and stored.count() == 4


def test_materialise_keeps_rows_and_schema(spark):
    df = spark.range(5).withColumn("t", F.lit("x"))
    kept = materialise(df)
    assert kept.columns == df.columns and rows(kept, "id") == rows(df, "id")


def test_csv_reading(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("\ufeffSK_ID_CURR,AMT,NAME\n1, 2.5,a\n2,,b\n3,bad,\n", encoding="utf-8")
    text = readers.read_csv_text(spark, str(path))
    assert text.columns == ["SK_ID_CURR", "AMT", "NAME"]
    assert set(dict(text.dtypes).values()) == {"string"}
    typed = rows(readers.read_csv(spark, str(path), "AMT double, SK_ID_CURR bigint"), "SK_ID_CURR")
    assert [r["AMT"] for r in typed] == [2.5, None, None]
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_csv(spark, str(path), "OTHER double")


def test_append_limit_and_split(spark):
    train = spark.createDataFrame([(1, 0), (2, 1)], "k int, TARGET int")
    test = spark.createDataFrame([(3,)], "k int")
    both = readers.append(train, test)
    labelled, unlabelled = readers.split_labelled(both, "TARGET")
    assert labelled.count() == 2 and [r["k"] for r in rows(unlabelled)] == [3]
    assert [r["k"] for r in rows(readers.first_rows(both, ["k"], 2))] == [1, 2]
    assert readers.first_rows(both, ["k"], 0).count() == 3


def test_sinks_do_not_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25)], "k int, score double")
    for fmt in ("parquet", "csv", "json"):
        path = sinks.write_new(df, str(tmp_path / fmt), fmt)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            sinks.write_new(df, path, fmt)
    path = sinks.write_submission(df, str(tmp_path / "sub"), "k", "score")
    assert rows(spark.read.option("header", True).csv(path)) == [{"k": "1", "TARGET": "0.25"}]
    cells = spark.createDataFrame([(1, 2.0), (0, 1.0)], "position int, value double")
    assert sinks.write_vector(cells, str(tmp_path / "vec")) == 2
    with pytest.raises(ValueError, match="unknown format"):
        sinks.write_new(df, str(tmp_path / "x"), "xml")


# --- model ------------------------------------------------------------------------------------


def test_folds_score_every_row_once(spark):
    df = spark.range(120).select(
        "id",
        F.when(F.col("id") < 90, (F.col("id") % 3 == 0).cast("int")).alias("y"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("double")).alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
    )
    result = model.train_folds(df, "id", "y", ["a", "b"], folds=3, trees=2, depth=2)
    scored = rows(result.out_of_fold, "id")
    assert [r["id"] for r in scored] == list(range(90))
    assert all(0.0 <= r["score"] <= 1.0 for r in scored)
    assert sorted({r["fold"] for r in scored}) == [0, 1, 2]
    assert [r["id"] for r in rows(result.scores, "id")] == list(range(90, 120))
    names = {r["feature"] for r in rows(result.importance)}
    assert names == {"a", "b"}
    assert result.importance.count() == 6
    # Two small steps leave the folds' base rates apart, so each fold is ranked by itself.
    aucs = rows(ordering.roc_auc(result.out_of_fold, "label", "score", "fold").dropna())
    assert len(aucs) == 3 and all(r["auc"] > 0.8 for r in aucs)


def test_model_queries_train_with_the_defaults(spark, monkeypatch):
    from entityloom.plans import star_queries

    given = []

    def train_folds(df, *args, **named):
        given.append((args[3:], set(named)))
        return model.FoldResult(df, df, df)

    monkeypatch.setattr(star_queries.model, "train_folds", train_folds)
    star_queries.QUERIES["oof_predictions"](spark, "/root/testdata/sf0.001")
    assert given == [((star_queries.FOLDS,), {"stages"})]


def test_prepared_keys(spark):
    df = spark.createDataFrame([("103 ",), ("101",), ("101",)], "k string")
    assert [r["k"] for r in align.prepare_keys(df, "k", True).collect()] == ["101", "103"]
    with pytest.raises(ValueError, match="repeated in 1 rows"):
        align.prepare_keys(df, "k", False)
    blank = spark.createDataFrame([("1",), (" ",)], "k string")
    with pytest.raises(ValueError, match="blank in 1 rows"):
        align.prepare_keys(blank, "k", True)
    with pytest.raises(ValueError, match="no k values"):
        align.prepare_keys(df.limit(0), "k", True)
    assert [r["key"] for r in align.prepare_key_union({"a": (df, "k")}).collect()] == ["101", "103"]
    with pytest.raises(ValueError, match="b: 1 blank"):
        align.prepare_key_union({"a": (df, "k"), "b": (blank, "k")})


def test_alignment(spark):
    receiver = spark.createDataFrame([("101", 0), ("102", 1), ("103", 0)], "k string, TARGET int")
    matches = spark.createDataFrame([("102", 0), ("103", 1)], "k string, position int")
    made = align.build_alignment(receiver, matches, matches, "k", "TARGET", seed=7)
    assert one(made.counts) == {"dense_slots": 3, "intersection": 2, "receiver_unmatched": 1}
    assert made.sender.columns == ["app_index", "k"]
    layout = {r["k"]: r for r in rows(made.receiver)}
    assert layout["102"]["TARGET"] == 1
    assert {r["k"]: r["app_index"] for r in rows(made.mapping)} == {
        k: layout[k]["app_index"] for k in ("102", "103")
    }
    assert [r["present"] for r in rows(made.presence, "app_index")].count(1.0) == 2
    stranger = spark.createDataFrame([("102", 0), ("999", 1)], "k string, position int")
    with pytest.raises(ValueError, match="1 matched keys are absent"):
        align.build_alignment(receiver, stranger, stranger, "k")
    with pytest.raises(ValueError, match="1 repeated"):
        align.build_alignment(receiver.union(receiver.limit(1)), matches, matches, "k")


def test_read_table_prefers_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\n1,2.5\n2,\n")
    csv = readers.read_table(spark, str(tmp_path), "a")
    assert dict(csv.dtypes) == {"k": "int", "x": "double"}
    declared = readers.read_table(spark, str(tmp_path), "a", "k string")
    assert dict(declared.dtypes) == {"k": "string"}
    stored = readers.store_parquet(spark, str(tmp_path), str(tmp_path), "a")
    assert rows(readers.read_table(spark, str(tmp_path), "a"), "k") == rows(stored, "k")
