"""Packing of token sequences into windows by Karmarkar-Karp differencing (operator 3).

Each task turns its documents into ids, cuts them into pieces and packs the
pieces in batches of a bounded number of tokens, so nothing is shuffled and no
document, source or group of copies can overload a task. Within a batch the
pieces are partial partitions of ``k`` windows; the two with the largest
imbalance are merged, the fullest window of the one with the emptiest of the
other, until one partition is left. When its fullest window exceeds the
capacity, ``k`` rises by one and the batch is partitioned again.

A task that is run again sees the same rows and gives the same windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityloom.llm.tokens import default_tokenizer, encoder, slices

WINDOW = 2048
#: Ends of documents are cut to pieces of at most this many ids.
PIECE = 512
#: Windows per batch, and how full they are planned to be.
BATCH_WINDOWS = 64
FILL = 0.995
END_ID = 1
#: Rows sent back at once.
ROWS = 512
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, capacity long"
)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` groups of item numbers with near-equal sums, fullest first.

    A partial partition is a list of (sum, members), fullest first, in which
    windows that are still empty are left out. Members are nested pairs until
    the end, so that merging two windows costs the same at any size.
    """
    heap = []
    for number, size in enumerate(sizes):
        heap.append((-size, number, [(size, number)]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        first = heapq.heappop(heap)[2]
        second = heap[0][2]
        alone_first, alone_second = k - len(second), k - len(first)
        # Fullest of the first with emptiest of the second; what is empty stays out.
        merged = first[: max(alone_first, 0)] + second[: max(alone_second, 0)]
        a, b = first[max(alone_first, 0) :], second[max(alone_second, 0) :]
        merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heapreplace(heap, (least - merged[0][0], tie, merged))
        tie += 1
    return [_members(x[1]) for x in heap[0][2]] if heap else []


def _members(nested) -> list[int]:
    found, left = [], [nested]
    while left:
        x = left.pop()
        if isinstance(x, tuple):
            left.extend(x)
        else:
            found.append(x)
    return found


def fill_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal groups, as few as the method finds, none above ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        k += 1


def cut(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length): whole windows first, then the end in near-equal pieces."""
    whole = n // window
    cuts = [(i * window, window) for i in range(whole)]
    rest = n - whole * window
    parts = -(-rest // piece)
    at = whole * window
    for i in range(parts):
        size = rest // parts + (i < rest % parts)
        cuts.append((at, size))
        at += size
    return cuts


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    piece: int = PIECE,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece with its ids (on request) and their CRC-32, its window and its place there.

    A window's real length is ``sequence_length``; ``capacity`` is the length
    it is padded to (``window``, or its own length where that is a power of
    two). A null text is empty and gives the end id alone; rows with the same
    or no ``doc_id`` are packed each for itself; an empty table gives no rows;
    other columns are not read. A very long text fills windows of its own but for
    its end; ids of any size stay exact.
    """
    path = tokenizer or default_tokenizer()
    goal = int(BATCH_WINDOWS * window * FILL)
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_all
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 9 + [pa.binary()] * with_ids
        ready: list[tuple] = []
        pool: list[tuple] = []
        held = 0

        def place(group: list[tuple]) -> None:
            nonlocal sequence
            total = sum(p[2] for p in group)
            full = total if total & (total - 1) == 0 else window
            offset = 0
            for p in group:
                ready.append((*p[:5], sequence, offset, total, full, *p[5:]))
                offset += p[2]
            sequence += 1

        def place_pool() -> None:
            for group in fill_windows([p[2] for p in pool], window):
                place([pool[i] for i in group])
            pool.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ready), ROWS):
                columns = zip(*ready[at : at + ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            ready.clear()

        for batch in slices(batches):
            numbers = batch.column(0).to_pylist()
            for doc, raw in zip(numbers, encode(batch.column(1), end_id), strict=True):
                n = len(raw) // 4
                for at, size in cut(n, window, piece):
                    own = raw[4 * at : 4 * (at + size)]
                    p = (doc, at, size, zlib.crc32(own), n, own) if with_ids else (doc, at, size, zlib.crc32(own), n)
                    if size == window:
                        place([p])
                        continue
                    if held + size > goal:
                        place_pool()
                        held = 0
                    pool.append(p)
                    held += size
                if len(ready) >= ROWS:
                    yield from sent()
        if pool:
            place_pool()
        yield from sent()

    source = docs.select(
        F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text")
    )
    return source.mapInArrow(run, schema)
