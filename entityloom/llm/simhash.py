"""SimHash near-duplicates with bit-sliced comparison (operator 6).

Fingerprints that differ in at most three of 64 bits agree on at least two of
five bit blocks. Distinct fingerprints meet in the buckets of each such pair
of blocks; large buckets are cut into tiles, and every pair of tiles meets in a
task of its own, so no bucket is too large and none is cut short. Within a
task the candidates' bits lie in vertical planes, 64 candidates to a word; one
query bit at a time, carry-save counters add up all differences, and a query
is abandoned once every candidate has passed the radius. Only a spanning star
of each linked set leaves a task, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityloom.llm.graph import components
from entityloom.llm.workers import kept
from entityloom.session import materialise

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bit blocks (first bit, bits); two of five are free of differences at radius 3.
BIT_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TILE = 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint as an unsigned integer; a text without words has 0."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    spans = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of each whole text as a signed 64-bit integer; null counts as empty."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("simhash", dict)
        for texts in batches:
            found = np.array([simhash(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return hashed(F.coalesce(text, F.lit("")))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def close_pairs(
    queries: np.ndarray, candidates: np.ndarray | None = None, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of query and candidate of all pairs within ``radius`` bits.

    Without candidates, the queries are compared with one another, each pair once.
    """
    same = candidates is None
    lanes = queries if same else candidates
    n, m = len(queries), len(lanes)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = -(-m // 64)
    bits = np.zeros((width * 64, 64), dtype=np.uint8)
    bits[:m] = _bits(lanes)
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    masks = _bits(queries).astype(np.uint64) * ALL
    outside = np.ones((n, width * 64), dtype=np.uint8)
    outside[:, :m] = 0
    if same:
        outside[:, :m] = np.tri(n, m, dtype=np.uint8)
    over = np.packbits(outside, axis=1, bitorder="little").view("<u8").copy()
    alive = np.arange(n)
    counters = [np.zeros_like(over) for _ in range(int(radius).bit_length())]
    for bit in range(64):
        carry = planes[bit][None, :] ^ masks[alive, bit][:, None]
        for counter in counters:
            counter ^= carry
            carry &= ~counter  # carried where the sum became 0
        over |= carry
        if bit % 8 == 7:
            open_ = (over != ALL).any(axis=1)
            if open_.sum() <= 0.75 * len(alive):
                alive, over = alive[open_], over[open_]
                counters = [c[open_] for c in counters]
                if not len(alive):
                    break
    row, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    row = alive[row]
    if radius + 1 != 1 << len(counters):
        near = np.bitwise_count(queries[row] ^ lanes[lane]) <= radius
        row, lane = row[near], lane[near]
    return row, lane


def _stars(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """One edge to the set's root for each value linked by the pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(values[left].tolist(), values[right].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def _compare(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links within each (bucket, tile, tile) of rows that come sorted by them."""
    held: list[np.ndarray] = []  # small buckets that are compared together
    size = 0

    def edges(first: np.ndarray, second: np.ndarray | None = None) -> pd.DataFrame:
        first = np.unique(first)
        a, b = close_pairs(first.view(np.uint64), None if second is None else second.view(np.uint64), radius)
        if second is not None:
            b = b + len(first)
            first = np.concatenate([first, second])
        return pd.DataFrame(_stars(first, a, b), columns=["a", "b"], dtype="int64")

    def groups() -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf])
            keys = pdf[["bucket", "low", "high"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cuts = [0, *cuts.tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield one(pdf, a, b)
            rest = pdf.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield one(rest, 0, len(rest))

    def one(pdf: pd.DataFrame, a: int, b: int) -> tuple[bool, np.ndarray, np.ndarray]:
        part = pdf.iloc[a:b]
        split = bool(part["low"].iloc[0] != part["high"].iloc[0])
        return split, part["fp"].to_numpy(np.int64), part["tile"].to_numpy() == part["low"].iloc[0]

    for split, values, is_low in groups():
        if split:
            yield edges(values[is_low], values[~is_low])
            continue
        held.append(values)
        size += len(values)
        if size >= TILE:
            yield edges(np.concatenate(held))
            held, size = [], 0
    if held:
        yield edges(np.concatenate(held))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of column ``fp`` within ``radius`` bits.

    ``nodes`` holds distinct fingerprints. The bit blocks find all links up to a
    radius of three; a larger one is refused.
    """
    if radius > RADIUS:
        raise ValueError(f"the bit blocks serve radii up to {RADIUS}")
    keys = []
    for number, (x, y) in enumerate(combinations(BIT_BLOCKS, 2)):
        value = F.lit(number)
        for first, bits in (x, y):
            piece = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
            value = F.shiftleft(value.cast("long"), bits).bitwiseOR(piece)
        keys.append(value)
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / TILE)
    own = F.pmod(F.xxhash64("fp"), tiles)
    met = (
        keyed.join(shared, "bucket")
        .select("bucket", "fp", tiles.alias("tiles"), own.alias("tile"))
        .select("bucket", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select(
            "bucket",
            "fp",
            "tile",
            F.least("tile", "other").alias("low"),
            F.greatest("tile", "other").alias("high"),
        )
    )
    return (
        met.repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
        .mapInPandas(lambda batches: _compare(batches, radius), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, row: str = "doc_id"
) -> DataFrame:
    """(row, fp, component) of every row: the component is the smallest ``row`` reachable.

    Rows with one fingerprint are linked, whatever their text; texts without
    words share fingerprint zero. Repeated rows are kept. A missing ``row`` value
    never names a component that has another.
    """
    marks = materialise(docs.select(F.col(row), fingerprint(F.col("text"), shingle).alias("fp")), "simhash")
    nodes = marks.groupBy("fp").agg(F.min(row).alias("least"))
    rooted = components(links(nodes.select("fp"), radius)).withColumnRenamed("a", "fp")
    sets = nodes.join(rooted, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = sets.groupBy("root").agg(F.min("least").alias("component"))
    return marks.join(sets.join(named, "root").select("fp", "component"), "fp").select(row, "fp", "component")
