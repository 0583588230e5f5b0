"""SimHash, substrings, winnowing and spot signatures against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityloom.llm import graph, simhash, spots, substrings, winnowing
from tests.llm.conftest import edge_rows, table


def joined(pairs):
    """Root of every node, the smallest of its set."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(3, 2), (9, 9), (2, 3)]
    found = graph.components(spark.createDataFrame(pairs, "a long, b long"))
    expected = {x: r for x, r in joined([p for p in pairs if p[0] != p[1]]).items() if x != r}
    assert {r.a: r.root for r in found.collect()} == expected
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in rng.integers(0, 7, 200)]
    values = np.concatenate([base, base[rng.integers(0, 40, 200)] ^ np.array(flips)])
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    a, b = simhash.close_pairs(values, None, radius)
    assert {*zip(a.tolist(), b.tolist(), strict=True)} == {*zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1))), strict=True)}
    a, b = simhash.close_pairs(values[:50], values[50:], radius)
    assert {*zip(a.tolist(), b.tolist(), strict=True)} == {*zip(*map(np.ndarray.tolist, np.nonzero(near[:50, 50:])), strict=True)}


def test_simhash_of_small_texts():
    import xxhash

    assert simhash.simhash("") == simhash.simhash(" \t") == 0
    assert simhash.simhash("A  b\x0bC") == xxhash.xxh64_intdigest("a b c", 42) == simhash.simhash("a b c")
    assert simhash.simhash("one") == xxhash.xxh64_intdigest("one", 42)
    assert simhash.simhash("É") != simhash.simhash("é")


def test_links_split_large_buckets(spark, monkeypatch):
    """A dense ball of fingerprints, far larger than a tile, loses no link."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    ball = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))}
    ball |= {int(x) for x in rng.integers(1 << 62, size=200)}
    values = np.array(sorted(ball), dtype=np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(4)
    found = {r.a: r.root for r in graph.components(simhash.links(nodes)).collect()}
    u = values.view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    expected = joined(zip(values[a].tolist(), values[b].tolist(), strict=True))
    assert found == {x: r for x, r in expected.items() if x != r}
    with pytest.raises(ValueError, match="radii"):
        simhash.links(nodes, 4)


def test_near_duplicates(spark, edges, empty):
    found = simhash.near_duplicates(edges).collect()
    rows = [(d, simhash.simhash(t or "")) for d, t, _ in edge_rows()]
    assert sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in found) == sorted((d or -1, f) for d, f in rows)
    prints = sorted({f for _, f in rows})
    close = [(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 3]
    roots, least = joined(close), defaultdict(list)
    for d, f in rows:
        least[roots[f]].append(d)
    for r in found:
        ids = [d for d in least[roots[r.fp % (1 << 64)]] if d is not None]
        assert r.component == (min(ids) if ids else None)
    assert simhash.near_duplicates(empty).count() == 0


def brute_removal(rows, n):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows]
    for d, w in split:
        for i in range(len(w) - n + 1):
            if d is not None:
                key = tuple(w[i : i + n])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d or -1, len(w), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("window", "gram"), [(50, 8), (10, 3), (7, 7)])
def test_substring_removal(spark, edges, empty, window, gram):
    found = substrings.with_removal(edges, "removed", window, gram)
    assert found.columns == [*edges.columns, "removed"]
    got = [(r.doc_id or -1, r.removed.n_words, r.removed.kept) for r in found.collect()]
    assert sorted(got) == brute_removal(edge_rows(), window)
    assert substrings.with_removal(empty, "removed").count() == 0


def test_substrings_of_random_texts(spark):
    """Shared pieces at all offsets, joins of pieces, and texts that repeat themselves."""
    rng = np.random.default_rng(5)
    pieces = [[f"w{x}" for x in rng.integers(0, 30, rng.integers(3, 40))] for _ in range(12)]
    rows = []
    for d in range(60):
        picked = [w for i in rng.integers(0, 12, rng.integers(0, 7)) for w in pieces[i][rng.integers(0, 3) :]]
        rows.append((int(d * 3 % 61), " ".join(picked), "en"))
    found = substrings.with_removal(table(spark, rows), "removed", 10, 3).collect()
    got = sorted((r.doc_id or -1, r.removed.n_words, r.removed.kept) for r in found)
    assert got == [(d, n, k) for d, n, k in brute_removal([(d or -1, t, x) for d, t, x in rows], 10)]


def brute_hits(text, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(n, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_contamination(spark, edges, empty):
    passage = " ".join(f"word{i}" for i in range(60))
    items = [
        (10, passage),
        (9, "WORD20, " + " ".join(f"Word{i}!" for i in range(21, 32))),
        (2, "the cat"),
        (3, "Same id other"),
        (4, None),
        (5, "?!"),
        (6, " ".join(["again"] * 11)),
        (6, "日本語 テキスト"),
        (None, "small window that was open to the garden the cat and"),
        (11, "nothing like it is in any of these texts at all"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = winnowing.contamination(edges, benchmark).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in rows)
    expected = [(d or -1, *brute_hits(t, items)) for d, t, _ in edge_rows()]
    assert got == sorted(expected)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in rows)
    kept = winnowing.without_contaminated(edges, benchmark)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d for d, _, n, _ in expected if not n)
    assert winnowing.contamination(empty, benchmark).count() == 0
    none = winnowing.contamination(edges, benchmark.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(edge_rows()))


def brute_signatures(text):
    words = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    short = lambda *w: hashlib.md5(" ".join(w).encode()).hexdigest()[: spots.DIGITS]
    found = set()
    for i, w in enumerate(words):
        if w in spots.ANCHORS:
            found.add(short(w, *[x for x in words[i:] if x not in spots.ANCHORS][: spots.CHAIN]))
    if not found and words:
        found = {short(w, *words[i + 1 : i + 1 + spots.CHAIN]) for i, w in enumerate(words)}
    return sorted(found) if found or not text else [short(text)]


def test_signatures(spark, edges, empty):
    texts = edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for r in spots.with_signatures(texts, "text", "s").collect():
        assert r.s == brute_signatures(r.text)
    assert spots.with_signatures(empty, "text", "s").count() == 0


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0


def test_near_pairs_and_pruning(spark):
    rng = np.random.default_rng(2)
    base = [[f"s{x}" for x in rng.integers(0, 400, 30)] for _ in range(8)]
    sets = {}
    for i in range(80):
        own = list(base[i % 8])
        for _ in range(rng.integers(0, 6)):
            own[rng.integers(0, len(own))] = f"s{rng.integers(0, 400)}"
        sets[i] = sorted({*own})
    sets[80], sets[81] = sets[3], []
    signed = spark.createDataFrame([*sets.items()], "doc_id long, signatures array<string>")
    found = {(r.a, r.b): r.likeness for r in spots.near_pairs(signed, 0.8).collect()}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(tuple(s), i)
    ids = [i for s, i in first.items() if s]
    expected = {(a, b): x for a in ids for b in ids if a < b and (x := jaccard(sets[a], sets[b])) >= 0.8}
    assert found == pytest.approx(expected) and expected


def test_next_document(spark, edges):
    """The order is by descending id, repeated ids by text, missing ids last, in a ring."""
    texts = edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = spots.with_next(texts, ["text"], "text").collect()
    known = sorted([(-d, t or "") for d, t, _ in edge_rows() if d is not None])
    got = sorted((-r.doc_id, r.text, r.next_text) for r in found if r.doc_id is not None)
    assert [g[:2] for g in got] == known
    expected = [(*k, t) for k, (_, t) in zip(known, known[1:])]
    assert sorted(got[:-1]) == sorted(expected)
    missing = [r for r in found if r.doc_id is None]
    ring = {r.text: r.next_text for r in missing}
    assert len(ring) == 3 and got[-1][2] in ring
    at, seen = got[-1][2], []
    while at in ring and at not in seen:
        seen.append(at)
        at = ring[at]
    assert len(seen) == 3 and at == known[0][1]


def test_likeness_prunes_by_size(spark):
    df = spark.createDataFrame([(["a"], ["a", "b", "c"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(spots.likeness("a", "b")).collect()] == [1 / 3, 1.0, 0.0]
    assert [r[0] for r in df.select(spots.likeness("a", "b", 0.5)).collect()] == [0.0, 1.0, 0.0]
