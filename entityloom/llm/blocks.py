"""Searches of stated query vectors against all rows, block by block.

Rows are written once, so that their numbers hold when a task is run again.
Query rows and searched rows go to numbered blocks of bounded size; every block
of queries meets every block of rows in a group of its own, which one task
reads as Arrow batches. What leaves a group is bounded by the caller: a few
rows for each query.

A vector is an array of numbers; shorter ones count as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityloom.session import materialise

#: Rows of a block; a task holds one block of queries and one of rows.
BLOCK_ROWS = 8192
#: Blocks are made smaller, for more tasks at once, down to this size.
LEAST_ROWS = 512
#: Tasks of one round; further pairs of blocks share tasks and are read one after the other.
MOST_TASKS = 20_000
ROW, PAIR, SIDE, VECTOR = "_row", "_pair", "_side", "_vector"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """The rows as written to the shared folder, with a number of their own."""
    return materialise(rows, label).withColumn(ROW, F.monotonically_increasing_id())


def _blocks(queries: int, rows: int, parallel: int) -> tuple[int, int]:
    of_queries = max(1, -(-queries // BLOCK_ROWS))
    wanted = min(-(-parallel // of_queries), -(-rows // LEAST_ROWS))
    return of_queries, max(1, -(-rows // BLOCK_ROWS), wanted)


@dataclass
class Group:
    """One block of queries and one of rows: their columns, and their vectors as Arrow lists."""

    queries: pa.Table
    rows: pa.Table


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Rows come sorted by pair and side."""
    held: list[pa.RecordBatch] = []
    now = None

    def group() -> Group:
        table = pa.Table.from_batches(held).combine_chunks()
        split = int(np.searchsorted(table[SIDE].to_numpy(), 1))
        return Group(table.slice(0, split), table.slice(split))

    for batch in batches:
        pairs = batch.column(batch.schema.get_field_index(PAIR)).to_numpy()
        cuts = [0, *(np.flatnonzero(pairs[1:] != pairs[:-1]) + 1).tolist(), len(pairs)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and pairs[a] != now:
                yield group()
                held = []
            now = pairs[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield group()


def search(
    queries: DataFrame,
    rows: DataFrame,
    vector: str,
    query_columns: Sequence[str],
    row_columns: Sequence[str],
    found: Callable[[Group], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``found`` applied to each pair of blocks of two ``numbered`` tables.

    ``query_columns`` of the queries and ``row_columns`` of the rows reach
    ``found`` under their names with ``q_`` and ``r_`` in front, the row numbers
    as ``q__row`` and ``r__row``, the vectors as ``_vector``.
    """
    spark = rows.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_queries, of_rows = _blocks(queries.count(), rows.count(), parallel)
    own, other = ([*dict.fromkeys([ROW, *c])] for c in (query_columns, row_columns))

    def side(table: DataFrame, number: int, columns: list[str], mark: str, pairs: Column) -> DataFrame:
        kept = [F.col(c).alias(f"{mark}_{c}") for c in columns]
        return table.select(
            F.explode(pairs).alias(PAIR), F.lit(number).alias(SIDE), F.col(vector).alias(VECTOR), *kept
        )

    block_of_query = F.pmod(F.col(ROW), F.lit(of_queries)).cast("int")
    block_of_row = F.pmod(F.col(ROW), F.lit(of_rows)).cast("int")
    met = side(
        queries, 0, own, "q",
        F.transform(F.sequence(F.lit(0), F.lit(of_rows - 1)), lambda j: block_of_query * of_rows + j),
    ).unionByName(
        side(
            rows, 1, other, "r",
            F.transform(F.sequence(F.lit(0), F.lit(of_queries - 1)), lambda i: i * of_rows + block_of_row),
        ),
        allowMissingColumns=True,
    )
    dealt = met.repartitionById(min(of_queries * of_rows, MOST_TASKS), F.col(PAIR))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.queries.num_rows and group.rows.num_rows:
                yield from found(group)

    return dealt.sortWithinPartitions(PAIR, SIDE).mapInArrow(task, schema)


def cells(table: pa.Table, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, weight) of all cells of ``floor(factor * x)`` that are not 0, by row."""
    lists = table[VECTOR].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    sizes = np.asarray(lists.value_lengths())
    row = np.repeat(np.arange(len(sizes)), sizes)
    dimension = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor)
    there = weight != 0
    return row[there], dimension[there], weight[there]


def ids(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact integers of a column and which of them are missing (0 stands there)."""
    column = table[name].combine_chunks()
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)


def norms(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.bincount(row, weights=weight * weight, minlength=n)) if n else np.zeros(0)


def kind_for(most: float) -> np.dtype:
    """Number type in which integer products and sums of at most this size are exact.

    Partial sums of an inner product never pass the product of both norms.
    Beyond 2^52 Python's own integers are used.
    """
    if most < 1 << 23:
        return np.dtype(np.float32)
    return np.dtype(np.float64) if most < 1 << 52 else np.dtype(object)


def typed(weight: np.ndarray, kind: np.dtype) -> np.ndarray:
    if kind != object:
        return weight.astype(kind)
    out = np.empty(len(weight), dtype=object)
    out[:] = [int(w) for w in weight]
    return out


def longs(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; an error where one does not fit."""
    return np.array([int(s) for s in scores], dtype=np.int64) if scores.dtype == object else scores.astype(np.int64)


def first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, position) of the k highest allowed scores of each line, ties by smaller position."""
    n = scores.shape[1]
    if scores.dtype == object:
        least = min((s for s in scores.ravel()), default=0) - 1
    else:
        least = -np.inf
    shown = np.where(allowed, scores, least)
    if n > k:
        ordered = np.sort(shown, axis=1) if shown.dtype == object else np.partition(shown, n - k, axis=1)
        border = ordered[:, n - k, None]
        above = shown > border
        level = (shown == border) & allowed
        room = k - above.sum(axis=1, keepdims=True)
        above |= level & (np.cumsum(level, axis=1) <= room)
    else:
        above = allowed
    return np.nonzero(above & allowed)
