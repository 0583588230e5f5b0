"""Token ids in canonical, length-limited Huffman files (operator 4).

A folder holds two Parquet tables: ``codebook`` (id, bits) and ``blocks``. A
block is a run of whole documents in ascending ``doc_id`` order: their ids and
counts, the bit string, and the bit offset of every ``STRIDE``-th id. Blocks
need nothing but the codebook, so they are read in any order and number; in a
block all strides are decoded side by side through one table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityloom.llm.tokens import default_tokenizer, encoder, slices
from entityloom.session import materialise, release

LIMIT = 16
STRIDE = 128
#: Ids after which a block ends (with the document that passes it).
BLOCK_IDS = 1 << 18
END_ID = 1
BLOCKS = (
    "part int, start long, doc_ids array<bigint>, counts array<bigint>, n_ids long, "
    "bits binary, offsets binary"
)


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per symbol of the best code without words longer than ``limit`` (package-merge)."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(weights, kind="stable")
    single = np.asarray(weights, dtype=np.int64)[order]
    current, levels = single, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([single, pairs])
        rank = np.argsort(both, kind="stable")
        current = both[rank]
        levels.append(rank < n)
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_single in reversed(levels):
        singles = int(is_single[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical code: shorter words first, ids ascending within a length."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = np.asarray(ids)[order], np.asarray(bits, dtype=np.int64)[order]
        steps = np.left_shift(1, LIMIT - bits)
        first = np.cumsum(steps) - steps  # left-aligned to LIMIT bits
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code = np.zeros(size, dtype=np.int64)
        self.bits = np.zeros(size, dtype=np.int64)
        self.code[ids] = first >> (LIMIT - bits)
        self.bits[ids] = bits
        self.symbol = np.zeros(1 << LIMIT, dtype="<u4")
        self.length = np.ones(1 << LIMIT, dtype=np.int64)
        used = int(steps.sum())
        self.symbol[:used] = np.repeat(ids, steps)
        self.length[:used] = np.repeat(bits, steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bit string and the bit offset of each stride."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        shifted = self.code[ids] << (24 - bits - (at & 7))
        byte = at >> 3
        total = int(ends[-1] + 7) // 8 if len(ids) else 0
        out = np.zeros(total + 3)
        for i, part in enumerate((shifted >> 16, (shifted >> 8) & 255, shifted & 255)):
            out[i : i + total] += np.bincount(byte, weights=part, minlength=total)
        return out[:total].astype(np.uint8).tobytes(), at[::STRIDE].astype("<u8").tobytes()

    def decode(self, bits: bytes, offsets: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(offsets, dtype="<u8").astype(np.int64)
        raw = np.frombuffer(bits + b"\0\0\0", dtype=np.uint8).astype(np.int64)
        window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        last = len(window) - 1
        out = np.empty((STRIDE, len(at)), dtype="<u4")
        for step in range(STRIDE):
            index = (window[np.minimum(at >> 3, last)] >> (8 - (at & 7))) & 0xFFFF
            out[step] = self.symbol[index]
            at += self.length[index]
        return out.T.reshape(-1)[:n]


def ordered_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Written ids of whole texts, range-sorted by ``doc_id``, with their place in their part.

    Parts follow the ascending order; rows without ``doc_id`` come first, rows
    with the same one in the order of a hash of their texts, which also spreads
    them over parts. Ids below 2^16 take two bytes each, others four. The last row of a part has no place (``at`` -1): its ``ids`` are the
    counts of the part's ids, as 64-bit integers by id.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_column
        part, before = TaskContext.get().partitionId(), 0
        total = np.zeros(0, dtype="<i8")
        for batch in slices(batches):
            ids, n = encode(batch.column(2), end_id)
            ends = before + np.cumsum(n)
            before = int(ends[-1])
            total = _added(total, np.bincount(ids))
            if ids.max() < 1 << 16:
                ids = ids.astype("<u2")
            yield _ids_batch(part, batch.column(0), ends - n, n, ids.itemsize * n, ids)
        yield _ids_batch(part, pa.nulls(1, pa.int64()), [-1], [0], [total.nbytes], total)

    text = F.coalesce("text", F.lit(""))
    # Bounds of ranges are sampled from ids and hashes: texts may be long.
    source = docs.select(
        F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("_hash"), text.alias("_text")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = source.repartitionByRange(parts, "_doc", "_hash").sortWithinPartitions("_doc", "_hash")
    schema = "part int, doc_id long, at long, n long, ids binary"
    return materialise(placed.mapInArrow(run, schema), "token-ids")


def short_ids(raw: bytes, n: int) -> np.ndarray:
    """``n`` ids of two or four bytes each."""
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")


def _added(total: np.ndarray, found: np.ndarray) -> np.ndarray:
    if len(found) > len(total):
        total, found = found.astype("<i8"), total
    total[: len(found)] += found
    return total


def _ids_batch(part: int, docs: pa.Array, at, n, sizes, values: np.ndarray) -> pa.RecordBatch:
    cuts = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    columns = [
        pa.array(np.full(len(docs), part, dtype=np.int32)),
        docs,
        pa.array(at, pa.int64()),
        pa.array(n, pa.int64()),
        pa.Array.from_buffers(pa.binary(), len(docs), [None, cuts.buffers()[1], pa.py_buffer(values)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n", "ids"])


def id_counts(ids: DataFrame) -> DataFrame:
    """Global counts (id, n) from the counts that ``ordered_ids`` leaves for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype="<i8")
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = _added(total, np.frombuffer(raw, dtype="<i8"))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    partial = ids.filter("at < 0").select("ids").mapInArrow(run, "id long, n long")
    return partial.groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID
) -> None:
    """Encode every whole text (null: empty) and its end id into files below ``folder``.

    The driver sees one number per vocabulary entry and per written part, never
    rows of documents. An empty table gives empty files.
    """
    spark = docs.sparkSession
    written = ordered_ids(docs, tokenizer, end_id)
    ids = written.filter("at >= 0")
    counts = sorted((r.id, r.n) for r in id_counts(written).collect())  # at most the vocabulary
    symbols = np.array([c[0] for c in counts], dtype=np.int64)
    bits = code_lengths(np.array([c[1] for c in counts], dtype=np.int64))
    book = list(zip(symbols.tolist(), bits.tolist(), strict=True))
    spark.createDataFrame(book, "id long, bits long").coalesce(1).write.parquet(f"{folder}/codebook")
    starts, total = {}, 0
    for part, n in sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(symbols, bits)
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            part, _, at, _, _ = held[0]
            joined = short_ids(b"".join(x[4] for x in held), size)
            packed, offsets = codes.encode(joined)
            row = (part, starts[part] + at, [x[1] for x in held], [x[3] for x in held], size, packed, offsets)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip(row, _BLOCK_KINDS, strict=True)], names=_names(BLOCKS)
            )

        for batch in batches:
            for part, doc, at, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                follows = held and held[0][0] == part and held[-1][2] + held[-1][3] == at
                same = held and len(held[-1][4]) * n == len(raw) * held[-1][3]  # bytes an id
                if held and (size >= BLOCK_IDS or not follows or not same):
                    yield block()
                    held, size = [], 0
                held.append((part, doc, at, n, raw))
                size += n
        if held:
            yield block()

    ids.mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")
    release(written)


_LONGS = pa.list_(pa.int64())
_BLOCK_KINDS = (pa.int32(), pa.int64(), _LONGS, _LONGS, pa.int64(), pa.binary(), pa.binary())


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids on request, ids_crc32) of every document in the files."""
    book = spark.read.schema("id long, bits long").parquet(f"{folder}/codebook").collect()
    symbols = np.array([r.id for r in book], dtype=np.int64)
    bits = np.array([r.bits for r in book], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(symbols, bits)
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, counts, n, packed, offsets = (c[row] for c in batch.columns[1:])
                ids = codes.decode(packed.as_py(), offsets.as_py(), n.as_py())
                tokens = counts.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(tokens)
                raw = [x.tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.values,
                        pa.array(start.as_py() + ends - tokens),
                        pa.array(tokens),
                        *([pa.array(raw, pa.binary())] if with_ids else []),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    ],
                    names=_names(schema),
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    kept = "ids binary, " if with_ids else ""
    schema = f"doc_id long, start long, n_tokens long, {kept}ids_crc32 long"
    return blocks.mapInArrow(run, schema)
