"""Language, toxicity and licenses: rules, brute force and held-out accuracy."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityloom.llm import language, licenses, toxicity
from entityloom.llm.workers import share_path
from tests.llm.conftest import LANGS, edge_rows, table

FOLDER = "/root/testdata/sf0.01"


def brute_phrases(text, sample):
    """Greedy longest matches with the sample, within blocks."""
    symbols = "".join(c if c.isalpha() else " " for c in text.lower() + " ")  # a text ends with a blank
    symbols = "".join(c for i, c in enumerate(symbols) if c != " " or (i and symbols[i - 1] != " "))
    phrases = 0
    for at in range(0, len(symbols), language.BLOCK):
        block, i = symbols[at : at + language.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n < len(block) and block[i : i + n + 1] in sample:
                n += 1
            phrases += 1
            i += n
    return phrases


def test_cross_parsing_counts_longest_matches():
    samples = {k: " ".join([v] * 3) for k, v in LANGS.items()}
    parser = language.Parser(samples)
    texts = ["the cat", "Der Hund!! und 12 ñandú", "x", "", "q" * 700, LANGS["fr"] * 20]
    found, letters = parser.bits(texts)
    for row, text, n in zip(found, texts, letters, strict=True):
        assert n == sum(c.isalpha() for c in text)
        for k, lang in enumerate(parser.languages):
            sample = samples[lang]
            assert row[k] / parser.weights[k] == pytest.approx(brute_phrases(text, sample))


def test_automaton_knows_all_substrings():
    text = np.array([2, 3, 2, 3, 4, 2, 2, 3])
    moves = language.suffix_automaton(text, 6)

    def known(part):
        state = 0
        for c in part:
            state = moves[state, c]
            if not state:
                return False
        return True

    whole = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    assert all(known(p) for p in whole)
    assert not any(known(p) for p in [(4, 4), (3, 3), (2, 2, 2), (5,)])


def scripts():
    """Latin text by far the most; Chinese, Japanese and Korean of many letters, none of them shared."""
    rng = np.random.default_rng(7)
    ranges = {"ja": (0x3400, 500), "ko": (0xAC00, 500), "zh": (0x4E00, 500)}
    made = {k: [chr(a + i) for i in rng.integers(0, n, (60, 3)).ravel()] for k, (a, n) in ranges.items()}
    words = {k: ["".join(v[i : i + 3]) for i in range(0, len(v), 3)] for k, v in made.items()}
    texts = {k: [" ".join(rng.choice(v, 12)) for _ in range(12)] for k, v in words.items()}
    accented = [c for i in range(0xE0, 0x180) if (c := chr(i)).isalpha() and c == c.lower() and c != "ŉ"]
    latin = " ".join("".join(accented[i : i + 5]) for i in range(0, len(accented), 5))
    return texts | {k: [v] * 60 for k, v in (LANGS | {"xx": latin}).items()}


def test_every_letter_has_a_symbol():
    texts = scripts()
    samples = {k: " ".join(v[:-2]) for k, v in texts.items()}
    parser = language.Parser(samples)
    for lang, held in texts.items():
        assert {found for found, _ in parser.predict(held[-2:])} == {lang}
    mixed = [v[-1] + "ф" for v in texts.values()] + [" ".join(v[-1] for v in texts.values()) * 3]
    for row, text in zip(parser.bits(mixed)[0], mixed, strict=True):
        for k, lang in enumerate(parser.languages):
            assert row[k] / parser.weights[k] == pytest.approx(brute_phrases(text, samples[lang]))


def test_language_of_other_scripts(spark):
    share_path(spark)
    rows = [(1000 * k + i, t, lang) for k, (lang, v) in enumerate(scripts().items()) for i, t in enumerate(v)]
    docs = table(spark, rows)
    found = docs.select("lang", language.identify(F.col("text"), language.learn(docs))["lang"].alias("f"))
    assert found.filter("lang <> f").count() == 0


def test_language_of_edges(spark, edges, empty):
    samples = language.learn(edges)
    assert set(samples) == set(LANGS)
    found = edges.select("doc_id", "text", "lang", language.identify(F.col("text"), samples).alias("f")).collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.f.lang == "und") == (not letters)
        assert 0 <= r.f.score <= 1
        if r.doc_id is not None and r.doc_id < 5000:
            assert r.f.lang == r.lang
    assert language.learn(empty) == {}
    assert empty.select(language.identify(F.col("text"), {}).alias("f")).count() == 0
    unlearned = edges.select(language.identify(F.col("text"), {}).alias("f")).collect()
    assert {r.f.lang for r in unlearned} == {"und"}


def test_learning_leaves_out_held_out_rows(spark):
    import zlib

    rows = [(i, f"secret{i} the cat", "en") for i in range(40)]
    share_path(spark)
    sample = language.learn(table(spark, rows))["en"]
    for i in range(40):
        assert (f"secret{i} " in sample) == (zlib.crc32(str(i).encode()) % 3 != 1)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_held_out_accuracy(spark):
    share_path(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language.identify(F.col("text"), language.learn(docs))["lang"]
    right = docs.filter(language.held_out()).agg(F.avg((found == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.learn(docs, labels)
    scored = docs.withColumn("s", toxicity.toxicity(F.col("text"), model)).join(labels, "doc_id")
    rows = scored.filter(language.held_out()).select("s", "toxic").collect()
    toxic, clean = [[r.s for r in rows if r.toxic == k] for k in (1, 0)]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert wins > 0.75 and np.mean([s < 0.7 for s in clean]) > 0.97


def toxic_rows(n=150):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, 30)]
        bad = i % 3 == 0
        if bad:
            words[rng.integers(0, 30)] = "horrid"
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_a_planted_word(spark, edges):
    share_path(spark)
    rows, labels = toxic_rows()
    docs = table(spark, rows)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, given)
    found = docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("s")).collect()
    truth = {i: t for i, _, t in labels}
    assert np.mean([(r.s >= 0.7) == (truth[r.doc_id] == 1) for r in found]) > 0.97
    scores = edges.select(toxicity.toxicity(F.col("text"), model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scores)
    twice = toxicity.learn(docs, given)
    assert twice.score("horrid w1 w2") == model.score("horrid w1 w2")


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """A word in a few labelled rows among very many, and shards of any number, teach the model."""
    share_path(spark)
    rows, labels = toxic_rows(7000)
    rare = [i for i in range(7000) if not i % 3 and not i % 500]
    rows = [(i, t.replace("horrid", "w1") + " vile" if i in rare else t, lang) for i, t, lang in rows]
    docs = table(spark, rows)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    usable = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0]
    seen = toxicity.word_counts(docs.join(given, "doc_id").filter("crc32(cast(doc_id as string)) % 3 = 0"))
    found = {r.word: r.zeros + r.ones for r in seen.filter("word in ('vile', 'horrid')").collect()}
    assert found == {w: sum(w in t.split() for _, t, _ in usable) for w in ("vile", "horrid")}
    fitted, calibrated = [], []
    fit, calibrate = toxicity.fit, toxicity.calibrate
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 600)
    monkeypatch.setattr(toxicity, "fit", lambda d, *a: fitted.append(d.count()) or fit(d, *a))
    monkeypatch.setattr(toxicity, "calibrate", lambda m, d: calibrated.append(d.count()) or calibrate(m, d))
    model = toxicity.learn(docs, given)
    assert fitted == [len(usable)]
    assert calibrated == [sum(zlib.crc32(str(r[0]).encode()) % 3 == 2 for r in rows)]
    assert model.score("horrid w1 w2") >= 0.7 > model.score("w1 w2 w3")


def test_runs_of_unknown_words_keep_all_responses():
    rng = np.random.default_rng(3)
    tables = [[rng.normal(size=(5, toxicity.FILTERS)) for _ in range(w)] for w in toxicity.WIDTHS]
    for own in tables:
        for t in own:
            t[0] = 0
    bias = np.zeros(toxicity.FILTERS * len(toxicity.WIDTHS))
    for n in [*range(9), 60, 300]:
        ids = np.where(rng.random(n) < 0.15, rng.integers(1, 5, n), 0).astype(np.int32)
        short = toxicity.squeezed(ids)
        assert len(short) <= len(ids)
        assert (toxicity.pooled(short, tables, bias)[0] == toxicity.pooled(ids, tables, bias)[0]).all()


def toxic_model(rng, words):
    buckets = {w: i % 40 + 1 for i, w in enumerate([*words, "planet*", "stra\u00dfen*"])}
    tables = [[rng.normal(size=(41, toxicity.FILTERS)).astype(np.float32) for _ in range(w)] for w in toxicity.WIDTHS]
    for own in tables:
        for t in own:
            t[0] = 0
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    return toxicity.Model(buckets, tables, rng.normal(size=n), rng.normal(size=n), -1.0, {"": 0.4, "en": 0.6, "de": 0.5})


def test_texts_are_looked_up_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(12)
    words = ["the", "und", "horrid", "\u00e9t\u00e9", "\u0142za", "planetary", "stra\u00dfenbahn", "planet", "der", "zz"]
    ends = [" ", ", ", "_", "7", "\x85", "\u00a0", "\n", "\u3000", "\u00b2"]
    texts = ["", " ", ".", "\u0130stanbul", "\u0391\u03a3 \u0392\u03a3", *words, *(w.upper() for w in words)]
    for n in rng.integers(0, 60, 150):
        texts.append("".join(rng.choice(words) + rng.choice(ends) for _ in range(n)))
    texts += ["x " * 500 + "horrid " + "y " * 9, "the " * 700]
    model = toxic_model(rng, words[:5])
    for size in (1 << 21, 300):
        monkeypatch.setattr(toxicity, "CHUNK_CHARACTERS", size)
        assert [t for c in toxicity.chunks(texts) for t in c] == texts
        scores = model.scores(texts)
        for text, score in zip(texts, scores, strict=True):
            plain = re.findall(r"[^\W\d_]+", text.lower())
            assert toxicity.words_of(text) == plain
            ids = toxicity.squeezed(toxicity.ids_of(plain, model.buckets))
            found, sizes, languages = toxicity.looked_up([text], model.buckets)
            assert (found.tolist(), sizes.tolist(), languages) == (ids.tolist(), [len(ids)], [toxicity.profile(plain)])
            raw = toxicity._logistic(toxicity.pooled(ids, model.tables, model.bias)[0] @ model.weights + model.base)
            at = model.thresholds.get(languages[0], model.thresholds[""])
            assert score == toxicity._scaled(float(raw), at)
    assert model.scores([]) == []


def test_texts_are_pooled_together_with_their_places():
    rng = np.random.default_rng(13)
    tables = [[rng.integers(0, 4, (5, toxicity.FILTERS)).astype(float) for _ in range(w)] for w in toxicity.WIDTHS]
    bias = rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS))
    ids = [rng.integers(0, 5, n).astype(np.int32) for n in [*range(9), 30, 0, 2]]
    whole, sizes = toxicity.padded(np.concatenate(ids), np.array([len(x) for x in ids]))
    pool, places = toxicity.pooled_texts(whole, sizes, tables, bias, places=True)
    starts = np.cumsum(sizes) - sizes
    for i, own in enumerate(ids):
        expected, first = toxicity.pooled(own, tables, bias)
        assert (pool[i] == expected).all()
        assert all((p[i] - starts[i] == f).all() for p, f in zip(places, first, strict=True))


def test_toxicity_without_labels(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(edges, none) is None
    one = spark.createDataFrame([(10, 1, 0), (None, 1, 1), (20, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(edges, one) is None
    assert {r[0] for r in edges.select(toxicity.toxicity(F.col("text"), None)).collect()} == {0.0}
    assert empty.select(toxicity.toxicity(F.col("text"), None)).count() == 0


MIT = dict(licenses.TEMPLATES)["mit-text"]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit,mit-notice"),
        ("Available under the terms of the MIT license", "mit-notice"),
        ("x " + MIT.upper() + " y", "mit-text"),
        (MIT.replace("hereby", "now"), ""),
        ("Licensed under the Apache License, Version 2.0.", "apache-2,apache-2-notice"),
        ("licensed under the apache license 2", "apache-2-notice"),
        ("Apache License Version 3", ""),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-notice"),
        ("licensed under a Creative Commons Attribution Share Alike 4.0 International License", "cc-notice"),
        ("CC-BY-NC", "cc-by-nc"),
        ("see CC_BY/nc.", "cc-by-nc"),
        ("under.the_MIT  license", "mit,mit-notice"),
        ("", ""),
        ("no license here", ""),
    ],
)
def test_license_templates(text, labels):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE)
    found = scanner.scan(text)
    assert found[5] == labels and (found[6] == 1.0) == bool(labels)


def test_partial_notices_keep_their_score():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE)
    grant = (
        "Permission to use, copy, modify and distribute this software for any purpose with or "
        "without fee is hereby granted"
    )
    needed = max(a.needed for a in scanner.by_word["permission"] if a.label == "isc-text")
    assert scanner.scan(grant)[5:7] == ("", pytest.approx(19 / needed))
    assert scanner.scan(grant + " copyright")[6] == scanner.scan(grant)[6]
    own = licenses.Scanner([("own", "alpha beta gamma <<opt>> x <<end>> delta")], {"x y": "xy"})
    assert [own.scan(t)[6] for t in ("q alpha q", "alpha beta", "beta gamma delta")] == [0.25, 0.5, 0.0]


def test_text_templates_need_the_whole_notice():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE)
    mit = MIT.replace("copyright notice and this permission notice", "copyright notice and this permission notice "
                      "(including the next paragraph)").replace("the authors or copyright holders", "ACME, Inc.")
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. {}THIS "
        "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )
    third = (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. "
    )
    for text, label in [(mit, "mit-text"), (bsd.format(""), "bsd-text"), (bsd.format(third), "bsd-text")]:
        assert scanner.scan(text)[5:7] == (label, 1.0)
        words = text.split()
        labels, score = scanner.scan(" ".join(words[:-1]))[5:7]
        assert labels == "" and 0.9 < score < 1
        assert scanner.scan(" ".join(words[: len(words) // 2]))[5] == ""


def test_own_phrases_and_templates():
    scanner = licenses.Scanner([("own", "alpha <<opt>> beta <<end>> gamma")], {"x y": "xy"})
    assert scanner.scan("Alpha gamma, X-Y")[4:7] == ("xy", "own,xy", 1.0)
    assert scanner.scan("nothing")[5] == ""


def test_automaton_takes_optional_and_any_words():
    a = licenses.Automaton("x", "start <<opt>> maybe <<opt>> deeper <<end>> <<end>> <<any 2>> end")
    accepted = ["start end", "start maybe end", "start maybe deeper end", "start q end", "start maybe q r end"]
    refused = ["start q r s end", "start", "end", "start deeper maybe q end x", "maybe end"]
    assert all(a.run(t.split(), 0)[0] == len(t.split()) for t in accepted)
    assert all(a.run(t.split(), 0)[0] < 0 for t in refused)


def test_license_words_are_cut_from_utf8():
    """Any character in or between words: bytes give what a pattern over characters gives."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE)
    odd = [*map(chr, range(0x120)), "\u0130", "\u0301", "\u2028", "\u3000", "\ud7ff", "\uffff", "\U0001f600"]
    for c in odd:
        text = f"x{c}Under{c}the MIT{c} license, under the mit license{c}"
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
        starts = [i for i in range(len(words)) if words[i : i + 4] == "under the mit license".split()]
        found = scanner.scan(text.encode())
        assert found[:4] == (len(words), len(starts), *((starts[0], starts[-1]) if starts else (None, None)))
        assert found == scanner.scan(text)


def test_license_texts_reach_the_scanner_as_bytes(spark, edges):
    plan = edges.select(licenses.scan_licenses(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "as binary" in plan and "ArrowEvalPython" in plan


def test_licenses_over_a_table(spark, edges, empty):
    docs = edges.select("doc_id", F.concat_ws(" ", F.lit("under the MIT license"), "text", F.lit("Under The Mit License")).alias("text"))
    found = docs.select("text", licenses.scan_licenses(F.col("text")).alias("f")).collect()
    for r in found:
        assert (r.f.n_base, r.f.first_word, r.f.last_word) == (2, 0, r.f.n_words - 4)
    plain = edges.select(licenses.scan_licenses(F.col("text")).alias("f")).collect()
    assert len(plain) == len(edge_rows()) and all(r.f.n_base == 0 and r.f.first_word is None for r in plain)
    assert empty.select(licenses.scan_licenses(F.col("text"))).count() == 0
