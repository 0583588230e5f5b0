"""Substring dedup by content-cut blocks and windows looked up by hash (operator 10).

All documents are the reference, indexed by content-cut blocks: a block is a
run of windows (``WINDOW`` consecutive words) that share their least k-gram
hash, its anchor. Equal windows have equal anchors in any document, so a window
that occurs twice is always looked up under the same anchor.

This stands in place of a relative Lempel-Ziv parse; no greedy longest match
is made. A block that also stands in a document with a smaller id is marked as
a whole. Where an anchor is shared but the block around it differs, its windows
are looked up one by one, again under their anchor. The ranges that the marked
windows cover are merged; they are at least one window long, and their words
are the duplicate spans.

Keys pair two independent 64-bit hashes. Minima per key merge map-side; a
passage in a third of all documents is one row per task there, and the join
back is left to Spark, which splits hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityloom.llm.workers import kept
from entityloom.session import materialise

WINDOW = 50
GRAM = 8
#: Bytes of text that are hashed together.
BATCH = 1 << 18
BYTE_BASE, GRAM_BASE, BLOCK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of odd bases and of their inverses modulo 2**64, as far as needed."""

    def __init__(self):
        self.kept: dict[int, np.ndarray] = {}

    def of(self, base: int, n: int) -> np.ndarray:
        found = self.kept.get(base)
        if found is None or len(found) < n:
            steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
            steps[0] = 1
            found = np.cumprod(steps, dtype=np.uint64)
            if len(found) <= 2 * BATCH:
                self.kept[base] = found
        return found[:n]

    def sums(self, values: np.ndarray, base: int) -> np.ndarray:
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.of(base, len(values)), out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        """Hash of each span, wherever it stands."""
        back = self.of(pow(base, -1, 1 << 64), len(sums))
        return _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def _powers() -> _Powers:
    return kept("substrings", _Powers)


@dataclass
class Parsed:
    """Words and blocks of several texts; positions count through all of them."""

    words_before: np.ndarray  # first word of each text, and the end
    doc: np.ndarray  # of each block
    low: np.ndarray  # first window of each block, and the last
    high: np.ndarray
    anchor: np.ndarray
    block: np.ndarray
    window: np.ndarray  # hash of the window that starts at each word, if one does


def parse(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Parsed:
    powers = _powers()
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    end = end[-len(start) :] if len(start) else start
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    before = np.concatenate([[0], np.searchsorted(start, text_ends)]).astype(np.int64)
    n = len(start)
    empty = np.zeros(0, dtype=np.int64)
    if n < window:
        return Parsed(before, empty, empty, empty, empty, empty, empty)
    word = powers.spans(powers.sums(raw.astype(np.uint64) + np.uint64(1), BYTE_BASE), start, end, BYTE_BASE)
    at = np.arange(n - gram + 1)
    least = powers.spans(powers.sums(word, GRAM_BASE), at, at + gram, GRAM_BASE)
    wide, size = window - gram + 1, 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    owner = np.repeat(np.arange(len(texts)), np.diff(before))
    starts = np.arange(n - window + 1)
    whole = owner[starts] == owner[starts + window - 1]
    sums = powers.sums(_mix(word ^ np.uint64(BLOCK_BASE)), BLOCK_BASE)
    windows = powers.spans(sums, starts, starts + window, BLOCK_BASE)
    first = whole.copy()
    first[1:] &= ~(whole[:-1] & (least[1:] == least[:-1]) & (owner[starts[1:]] == owner[starts[:-1]]))
    low = np.flatnonzero(first)
    last = whole.copy()
    last[:-1] &= ~whole[1:] | first[1:]
    high = np.flatnonzero(last)
    block = powers.spans(sums, low, high + window, BLOCK_BASE)
    return Parsed(
        before,
        owner[low],
        low,
        high,
        least[low].view(np.int64),
        block.view(np.int64),
        windows.view(np.int64),
    )


def _parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of at most ``BATCH`` bytes of text together, at least one."""
    size = pdf["text"].map(len).cumsum() // BATCH
    yield from (part for _, part in pdf.groupby(size, sort=False))


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, anchor, block) of every document with an id, without repeats in one text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _parts(pdf):
                p = parse(_bytes(part["text"]), window, gram)
                ids = part["doc_id"].to_numpy()[p.doc]
                yield pd.DataFrame(
                    {"doc_id": ids, "anchor": p.anchor, "block": p.block}
                ).drop_duplicates()

    return docs.filter("doc_id IS NOT NULL").mapInPandas(run, "doc_id long, anchor long, block long")


def boundary_windows(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, anchor, window) of all windows under the anchors wanted of a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text, anchors in zip(pdf["doc_id"], pdf["text"], pdf["anchors"], strict=True):
                p = parse(_bytes([text]), window, gram)
                hit = np.flatnonzero(np.isin(p.anchor, anchors))
                count = p.high[hit] - p.low[hit] + 1
                at = np.repeat(p.low[hit], count) + np.arange(count.sum())
                at -= np.repeat(np.cumsum(count) - count, count)
                yield pd.DataFrame(
                    {"doc_id": doc, "anchor": np.repeat(p.anchor[hit], count), "window": p.window[at]}
                ).drop_duplicates()

    lists = wanted.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    return docs.join(lists, "doc_id").mapInPandas(run, "doc_id long, anchor long, window long")


def with_removal(docs: DataFrame, out: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with a struct ``out`` of n_words, spans and kept.

    ``spans`` are the duplicate factors as (start, end) word positions, ``kept``
    the words outside them joined by one space.
    A null text has no words, one shorter than a window is kept whole. A row
    without ``doc_id`` is never removed from and never removes; rows that share
    one do not remove from each other. Other columns are passed on as they are.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    cut = materialise(blocks(base, window, gram), "blocks")
    index = cut.groupBy("anchor", "block").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    whole = (
        cut.join(index.filter("least < most").select("anchor", "block", "least"), ["anchor", "block"])
        .filter("doc_id > least")
        .groupBy("doc_id")
        .agg(F.collect_set("block").alias("_found_blocks"))
    )
    differing = (
        index.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("least").alias("b"))
        .filter("n > 1 AND a < b")
        .select("anchor")
    )
    wanted = index.join(differing, "anchor").select(F.col("least").alias("doc_id"), "anchor")
    seen = materialise(boundary_windows(base, wanted, window, gram), "windows")
    repeated = (
        seen.groupBy("anchor", "window")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
    )
    single = (
        seen.join(repeated.select("anchor", "window", "least"), ["anchor", "window"])
        .filter("doc_id > least")
        .groupBy("doc_id")
        .agg(F.collect_set("window").alias("_found_windows"))
    )
    found = whole.join(single, "doc_id", "full").withColumnRenamed("doc_id", "_found_id")
    known = docs.join(found, docs["doc_id"] == found["_found_id"], "left")
    removed = _removal(window, gram)(F.coalesce("text", F.lit("")), "_found_blocks", "_found_windows")
    return known.select(*(docs[c] for c in docs.columns), removed.alias(out))


def factors(text: bytes, blocks_: list[int], windows: list[int], window: int, gram: int) -> np.ndarray:
    """(start, end) of the maximal factors of one text."""
    p = parse([text], window, gram)
    n = int(p.words_before[-1])
    starts = np.zeros(n + 1, dtype=np.int64)
    hit = np.isin(p.block, blocks_)
    np.add.at(starts, p.low[hit], 1)
    np.add.at(starts, p.high[hit] + 1, -1)
    is_start = np.cumsum(starts)[: len(p.window)] > 0
    is_start |= np.isin(p.window, windows)
    at = np.flatnonzero(is_start)
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    inside = np.concatenate([[0], (np.cumsum(cover)[:n] > 0).astype(np.int8), [0]])
    edge = np.diff(inside)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _removal(window: int, gram: int):
    @F.pandas_udf("n_words long, spans array<struct<start:long,end:long>>, kept string")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for text, in_blocks, in_windows in zip(*columns, strict=True):
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                spans = np.zeros((0, 2), dtype=np.int64)
                if in_blocks is not None or in_windows is not None:
                    lists = [[] if x is None else x for x in (in_blocks, in_windows)]
                    spans = factors(raw, *lists, window, gram)
                cuts = [0, *spans.ravel().tolist(), len(words)]
                left = [w for a, b in zip(cuts[::2], cuts[1::2], strict=True) for w in words[a:b]]
                kept = b" ".join(left).decode("utf-8")
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans.tolist()], kept))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "kept"])

    return remove
