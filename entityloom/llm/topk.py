"""Exact top-k search by term-at-a-time accumulation (operator 13).

The cells of the rows of a tile are kept as postings: for every dimension the
rows that have it and their weights (written out with zeros where most rows
have it). The sparse cells of a tile of queries, one dimension after the other,
scatter their products into a dense array of scores. No posting is skipped, so
all scores are exact. Partition selection keeps the k highest of a tile, and
the lists of tiles, then of blocks, are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityloom.llm import blocks

TILE_QUERIES = 256
TILE_ROWS = 2048


def postings(row: np.ndarray, dimension: np.ndarray, weight: np.ndarray, n: int) -> dict:
    """Rows and weights by dimension, of cells that come by row."""
    order = np.argsort(dimension, kind="stable")
    row, dimension, weight = row[order], dimension[order], weight[order]
    cuts = [0, *(np.flatnonzero(dimension[1:] != dimension[:-1]) + 1).tolist(), len(row)]
    lists = {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        if 2 * (b - a) >= n:
            full = np.zeros(n, dtype=weight.dtype)
            full[row[a:b]] = weight[a:b]
            lists[int(dimension[a])] = (slice(None), full)
        else:
            lists[int(dimension[a])] = (row[a:b], weight[a:b])
    return lists


def scatter(queries: dict, rows: dict, n: int, m: int, kind: np.dtype) -> np.ndarray:
    """Scores of n queries and m rows, all dimensions added up."""
    scores = np.zeros((n, m), dtype=kind)
    for dimension, (of_query, own) in queries.items():
        if dimension not in rows:
            continue
        of_row, theirs = rows[dimension]
        product = own[:, None] * theirs
        if isinstance(of_query, slice) or isinstance(of_row, slice):
            scores[of_query, of_row] += product
        else:
            scores[np.ix_(of_query, of_row)] += product
    return scores


def _tiles(cells: tuple, n: int, size: int, kind: np.dtype) -> Iterator[tuple[int, int, dict]]:
    row, dimension, weight = cells
    weight = blocks.typed(weight, kind)
    for start in range(0, n, size):
        a, b = np.searchsorted(row, [start, start + size])
        count = min(size, n - start)
        yield start, count, postings(row[a:b] - start, dimension[a:b], weight[a:b], count)


def _best(query: np.ndarray, position: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best of each query; positions follow the order of ties."""
    order = np.lexsort((position, -score, query))
    query, position, score = query[order], position[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[place < k], position[place < k], score[place < k]


def top(group: blocks.Group, factor: float, k: int) -> Iterator[pa.RecordBatch]:
    """(query row, its id, id of row, score) of the k best rows of the block for each query."""
    identity, absent = blocks.ids(group.rows, "r_id")
    order = np.lexsort((identity, absent))
    rows = group.rows.take(pa.array(order))
    identity, absent = identity[order], absent[order]
    own, nameless = blocks.ids(group.queries, "q_id")
    number = group.queries["q__row"].to_numpy()
    n, m = group.queries.num_rows, rows.num_rows
    left, right = blocks.cells(group.queries, factor), blocks.cells(rows, factor)
    lengths = [blocks.norms(c[0], c[2], size) for c, size in ((left, n), (right, m))]
    kind = blocks.kind_for(float(lengths[0].max()) * float(lengths[1].max()))
    lists = list(_tiles(right, m, TILE_ROWS, kind))
    for start, count, queries in _tiles(left, n, TILE_QUERIES, kind):
        asking, unnamed = (x[start : start + count, None] for x in (own, nameless))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
        for at, size, postings_ in lists:
            scores = scatter(queries, postings_, count, size, kind)
            others = (identity[at : at + size] != asking) | absent[at : at + size] | unnamed
            query, position = blocks.first(scores, others, k)
            new = (query, position + at, scores[query, position])
            best = _best(*(np.concatenate(x) for x in zip(best, new, strict=True)), k)
        query, position, score = best
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(number[start + query], pa.int64()),
                pa.array(own[start + query], pa.int64(), mask=nameless[start + query]),
                pa.array(identity[position], pa.int64(), mask=absent[position]),
                pa.array(blocks.longs(score), pa.int64()),
            ],
            names=["_query", "query_id", "_id", "score"],
        )


def search(
    table: DataFrame, asks: Column, row_id: str, vector: str, factor: float = 1.0, k: int = 20
) -> DataFrame:
    """(query_id, rank, the id, score): the k highest inner products of each asking row.

    Components become ``floor(factor * x)``. Rows without a usable vector (null,
    or with a null or non-finite component) take no part; an empty vector scores
    0 with every row. Rows with the query's id are its own and not found; a
    missing id is never a query's own and stands last among ties. Repeated rows
    are rows of their own: each is found, and each asking row has its own ranks.
    An empty table gives no rows. Other columns, whatever their names, are
    neither read nor returned. A returned score beyond 64 bits is an error.
    """
    own = F.col(row_id).cast("long")
    rows = blocks.numbered(
        table.filter(blocks.usable(F.col(vector))).select(
            own.alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).alias("v")
        ),
        "vectors",
    )
    found = blocks.search(
        rows.filter("asks"),
        rows,
        "v",
        ["id"],
        ["id"],
        lambda group: top(group, factor, k),
        "_query long, query_id long, _id long, score long",
    )
    order = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("_id").alias(row_id), "score")
