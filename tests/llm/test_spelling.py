"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from entityloom.llm import spelling
from tests.llm.conftest import edge_rows, table

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_words(rows):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


def test_vocabulary(spark):
    rows = edge_rows()
    rows += [(i, "Wherefore ÀÉÎÖØ÷×ÿabcd naïveté wherefore-Wherefore Āwherefore wherefore2x", "en") for i in range(400)]
    rows += [(7000, "wherefore " * 50_000, "en"), (7000, "a" * 100_000 + " " + "a" * 100_000, "en")]
    found = spelling.vocabulary(table(spark, rows))
    assert {r.word: r.n for r in found.collect()} == brute_words(rows)


def random_words(rng, n, letters="abé"):
    base = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(n)]
    for w in list(base):
        for _ in range(3):
            p = rng.randrange(len(w))
            base.append(w[:p] + rng.choice(["", rng.choice(letters), w[p] + rng.choice(letters)]) + w[p + 1 :])
    return {w: rng.choice([2, 3, 25, 40, 300, 4000, 40_000]) for w in base if len(w) >= 7}


@pytest.mark.parametrize("hot", [64, 2])
def test_variants_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(hot)
    counts = random_words(rng, 150)
    counts |= {"prefixes" + "".join(rng.choices("abcdefgh", k=6)): rng.choice([2, 20, 200]) for _ in range(150)}
    counts |= {"x" * 400: 2, "x" * 401: 40, "x" * 200 + "y" + "x" * 200: 30, "ÀÉÎÖØÿÿ": 2, "ÀÉÎÖØÿe": 20}
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    got = rows_of(spelling.variants(words))
    assert len(got) == len(counts)
    assert set(got) == brute_variants(counts)


def test_long_chains_and_ties(spark):
    counts = {"abcdefg" + "h" * i: 2 * 10**i for i in range(9)}
    counts |= {"zabcdefg": 20, "qqqqqqq": 5, "qqqqqqa": 50, "qqqqqqb": 50, "rrrrrrr": 5, "rrrrrra": 49}
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = {r[0]: r for r in rows_of(spelling.variants(words))}
    assert set(got.values()) == brute_variants(counts)
    assert got["abcdefg"][2] == "abcdefg" + "h" * 8
    assert got["qqqqqqq"][1] == "qqqqqqa" and got["rrrrrrr"][1] is None


def test_empty(spark, empty):
    assert rows_of(spelling.variants(spelling.vocabulary(empty))) == []


def test_every_edit_is_met(spark):
    word = "abcdefghij"
    edits = {word[:i] + x + word[j:] for i in range(11) for j in (i, i + 1) for x in ("", "z") if j <= 10}
    edits = {w for w in edits if one_edit(word, w)}
    words = spark.createDataFrame([(w, 2) for w in edits | {word}], "word string, n long")
    pairs = {frozenset(r) for r in spelling.near_pairs(words).collect()}
    assert {p for p in pairs if word in p} == {frozenset((word, w)) for w in edits}
