"""Token counts, packing and Huffman files against the tokenizers library itself."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from entityloom.llm import huffman, merges, packing, tokens
from entityloom.llm.tokens import WordEncoder, as_bytes, as_ids, default_tokenizer
from entityloom.llm.workers import share_path
from tests.llm.conftest import edge_rows

TEXTS = [t or "" for _, t, _ in edge_rows()]


@pytest.fixture(scope="module")
def word():
    return WordEncoder(default_tokenizer(), memory_words=40)


@pytest.fixture(scope="module")
def pair():
    return merges.TokenCounter(default_tokenizer(merges.BYTE_TOKENIZER))


def library(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_ids_are_the_librarys(word):
    own = ["don't a's x!!y <|endoftext|>!", "A\x1cB", "Σίσυφος ΑΣ", "12ab²", "é É"]
    for text, raw in zip(TEXTS + own, word.encode_all(TEXTS + own), strict=True):
        assert raw == as_bytes(library(default_tokenizer(), text))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAÉß '!.<|>12\n\t\x1c 　日\U0001f389")), max_size=40))
def test_counts_are_the_librarys(text):
    path = default_tokenizer(merges.BYTE_TOKENIZER)
    assert merges.TokenCounter(path).count(text) == len(library(path, text))


def test_counts_over_a_table(spark, edges, empty, pair):
    found = edges.select("text", merges.n_tokens(F.col("text")).alias("n")).collect()
    assert all(r.n == len(library(default_tokenizer(merges.BYTE_TOKENIZER), r.text or "")) for r in found)
    assert pair.count("a" * 5000) == len(library(default_tokenizer(merges.BYTE_TOKENIZER), "a" * 5000))
    assert empty.select(merges.n_tokens(F.col("text"))).count() == 0


def test_differencing_is_near_equal_and_whole():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 512, 300).tolist()
    groups = packing.differencing(sizes, 40)
    assert sorted(i for g in groups for i in g) == list(range(300))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) < 0.2 * np.mean(sums)
    assert packing.differencing([], 3) == []
    assert packing.fill_windows([5, 5, 5], 5) == [[2], [1], [0]] or len(packing.fill_windows([5, 5, 5], 5)) == 3


def test_windows_rise_with_capacity():
    groups = packing.fill_windows([6, 6, 6], 10)
    assert len(groups) == 3


def test_packing_keeps_every_id_once(spark, edges, empty):
    pieces = packing.pack(edges, window=256, piece=64).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_window[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
    for window in by_window.values():
        window.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in window])
        assert [p.offset for p in window] == [0, *ends[:-1]]
        assert ends[-1] == window[0].sequence_length <= 256
        total = int(ends[-1])
        assert window[0].capacity == (total if total & (total - 1) == 0 else 256)
    for doc, text, _ in edge_rows():
        if doc is None or doc in (5014, 5015):
            continue
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        raw = as_bytes([*library(default_tokenizer(), text or ""), 1])
        assert b"".join(p.ids for p in parts) == raw and parts[0].doc_tokens == len(raw) // 4
    assert sum(p.length for p in by_doc[5014]) == 2 * by_doc[5014][0].doc_tokens
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("weights", [[5], [1, 1], [1, 2, 4, 8, 16, 32, 64], [1] * 300, [10**9, *range(1, 500)]])
def test_huffman_code_is_a_limited_prefix_code(weights):
    bits = huffman.code_lengths(np.array(weights), limit=12)
    assert bits.max() <= 12 and bits.min() >= 1
    assert sum(2.0 ** -int(b) for b in bits) <= 1
    order = np.argsort(weights, kind="stable")
    assert all(a >= b for a, b in zip(bits[order][:-1], bits[order][1:], strict=True) if len(weights) > 1)


def test_huffman_refuses_too_many_symbols():
    with pytest.raises(ValueError, match="more than 3 bits"):
        huffman.code_lengths(np.ones(9), limit=3)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    seen, counts = np.unique(np.concatenate([ids, [7]]), return_counts=True)
    book = huffman.Codebook(seen, huffman.code_lengths(counts))
    bits, offsets = book.encode(ids)
    assert len(offsets) == 8 * -(-n // huffman.STRIDE)
    assert (book.decode(bits, offsets, n) == ids).all()


def test_token_files(spark, edges, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 500)
    huffman.write_ids(edges, str(tmp_path / "a"))
    found = huffman.read_ids(spark, str(tmp_path / "a")).collect()
    assert len(found) == len(edge_rows())
    found.sort(key=lambda r: r.start)
    start = 0
    for r in found:
        assert r.start == start and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    known = [r.doc_id for r in found if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in found[:3]] == [None] * 3
    ids = {r.doc_id: bytes(r.ids) for r in found}
    for doc, text, _ in edge_rows():
        if doc not in (None, 5015):
            assert ids[doc] == as_bytes([*library(default_tokenizer(), text or ""), 1])
    huffman.write_ids(empty, str(tmp_path / "b"))
    assert huffman.read_ids(spark, str(tmp_path / "b")).count() == 0


BIG = [(2**53 + 1, "one big number"), (None, "none"), (2**53 + 2, "another"), (-(2**62) - 1, "least"), (2**53 + 1, "again")]


def big_ids(spark):
    """Ids that no double holds, beside a missing one in the same batch."""
    share_path(spark)
    return spark.createDataFrame(BIG, "doc_id long, text string").coalesce(1)


def test_large_ids_stay_exact_beside_missing_ones(spark, tmp_path):
    asked = sorted(i for i, _ in BIG if i is not None)
    pieces = packing.pack(big_ids(spark)).collect()
    assert sorted(p.doc_id for p in pieces if p.doc_id is not None) == asked and len(pieces) == len(BIG)
    huffman.write_ids(big_ids(spark), str(tmp_path / "a"))
    found = sorted(huffman.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, *asked]


def test_counts_of_parts_are_those_of_all_ids(spark, edges):
    written = huffman.ordered_ids(edges)
    ids = [huffman.short_ids(bytes(r.ids), r.n) for r in written.filter("at >= 0").collect()]
    seen, counts = np.unique(np.concatenate(ids), return_counts=True)
    assert sorted(map(tuple, huffman.id_counts(written).collect())) == list(zip(seen, counts, strict=True))


def test_checksums_without_ids(spark, edges):
    place = lambda r: (r.sequence_id, r.offset, r.length, r.ids_crc32)
    whole = packing.pack(edges).collect()
    bare = packing.pack(edges, with_ids=False)
    assert "ids" not in bare.columns
    assert sorted(map(place, bare.collect())) == sorted(map(place, whole))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in whole)


def test_words_of_an_earlier_generation_are_known(monkeypatch):
    word = WordEncoder(default_tokenizer(), memory_words=40)
    texts = [" ".join(f"{'abc'[k % 3]}w{(i * k) % 23}!" for k in range(30)) for i in range(1, 60)]
    for first in range(0, len(texts), 3):
        part = texts[first : first + 3]
        expected = [as_bytes(library(default_tokenizer(), t)) for t in part]
        assert word.encode_all(part) == expected
        assert len(word.memory) <= 40 + 120


def test_pieces_are_cut_as_the_library_cuts(word):
    parts = (
        "a b Sun t é É ß ÿ Ÿ × ÷ ' 's 'LL 're 1 ٣ ² ª µ <| <|endoftext|> </w> - , . ’ é İ ſ 中 _ ’s".split()
        + list(" \t\n\x0b\x00\x7f\x1c\x85\xa0")
    )
    chosen = random.Random(3)
    texts = ["".join(chosen.choices(parts, k=chosen.randint(0, 14))) for _ in range(4000)]
    library = word.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [as_ids(raw).tolist() for raw in word.encode_all(texts)] == [x.ids for x in library]


#: The vocabulary's rule of cutting, for lower-case texts of ASCII and Latin letters.
RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+", re.ASCII)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aStrEVlMd'9-,É ß\t\n×÷²<|日\x1c\x85", max_size=12), max_size=8))
def test_a_chunk_is_cut_by_the_rule(texts):
    data = [t.encode() for t in texts]
    cuts = np.cumsum([0, *map(len, data)])
    pieces, first, doubted = tokens._cut(np.frombuffer(b"".join(data), dtype=np.uint8), cuts)
    pieces.validate(full=True)
    for k, text in enumerate(texts):
        found = pieces[first[k] : first[k + 1]].to_pylist()
        if k in doubted:
            assert not found
        else:
            assert found == RULE.findall(text.lower())
            assert not any(c in text for c in "×÷²日\x1c\x85") and "<|" not in text
    assert first[-1] == len(pieces)


def test_each_piece_is_looked_up_once_a_chunk():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    word = WordEncoder(default_tokenizer())
    word.memory = Counted()
    texts = ["again, and again; été 7's " * 200] * 20
    raw = word.encode_all(texts)
    assert raw == [as_bytes(library(default_tokenizer(), texts[0]))] * 20
    assert Counted.asked <= 8


@pytest.mark.parametrize("size", [1, 40, 1 << 21])
def test_chunks_of_any_size_give_the_same_ids(monkeypatch, word, size):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", size)
    texts = [None, "", *TEXTS[:40], " ", "日本 語's", "", "l'été d'un sot 's", "'", "s", "<|endoftext|>", ""]
    whole = [[*library(default_tokenizer(), t or ""), 1] for t in texts]
    column = pa.array(["cut off", *texts, "off"]).slice(1, len(texts))
    ids, n = word.encode_column(column, 1)
    assert n.tolist() == [len(x) for x in whole] and ids.tolist() == sum(whole, [])
    assert word.encode_all([]) == [] and word.encode_all(["", " "]) == [b"", b""]
    assert word.encode_all(pa.nulls(2, pa.string()), 1) == [as_bytes([1])] * 2
