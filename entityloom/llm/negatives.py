"""Hard negatives by threshold joins (operator 11).

Both searches, for positives and for negatives, are joins with a threshold of
its own for every anchor. In a tile of anchors and rows the dimensions come
heaviest first. A row is indexed in its leading dimensions only: what follows
is left out as soon as the norms of the rest, of the row and of every anchor,
cannot reach a threshold. Partial scores are accumulated over this index,
pairs are dropped when partial score and product of remaining norms stay below
the threshold, and the few left are computed whole. Cells of a step are multiplied
as one matrix product, and so is what is left when many pairs are.

An anchor whose window holds too few rows asks again with a lower threshold, in
a further round of Spark jobs for such anchors only; the last round has none
below the window, so no result depends on the thresholds. Rounds are written to
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityloom.llm import blocks
from entityloom.session import materialise

TILE_ANCHORS = 256
TILE_CELLS = 1 << 17
#: Norms are rounded: a pair is dropped only where its bound is below by this share.
SLACK = 1e-5
#: Bounds have the scores' type: they are rounded by less than this share of the norms' product.
ROUNDING = 1e-6
#: Dimensions between two looks at the bounds.
STEP = 16
#: Pairs that are left are computed one by one once so few of all are.
FEW = 1 / 256
#: Thresholds of the rounds for positives, as a share of the anchor's squared norm.
POSITIVE_STEPS = (0.75, 0.5, 0.25, 0.0, None)
#: Thresholds for negatives, as a share of the least ceiling; the last is the window's floor.
NEGATIVE_STEPS = (0.9, 0.7, None)
OUT = "_anchor long, _window int, _id long, _score long"


def threshold_scores(
    anchors: np.ndarray, rows: np.ndarray, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with an inner product of at least ``least[anchor]``.

    Whole numbers in both tables; the number type holds all products exactly.
    """
    n, m = len(anchors), len(rows)
    if anchors.dtype == object:  # beyond the exact range of doubles: no bounds, all pairs
        scores = anchors @ rows.T
        a, r = np.nonzero(scores >= least.astype(object)[:, None])
        return a, r, scores[a, r]
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    anchors, rows = anchors[:, order], rows[:, order]
    width = len(order)

    def rests(x: np.ndarray) -> np.ndarray:
        squares = np.zeros((len(x), width + 1))
        squares[:, :-1] = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(squares) * (1 + SLACK)

    of_anchor, of_row = rests(anchors), rests(rows)
    indexed = np.full(m, width)
    if n and least.min() > 0:
        reach = (of_anchor / least[:, None]).max(axis=0)
        indexed = (reach * of_row >= 1).sum(axis=1)
    lowest = (least - ROUNDING * of_anchor[:, 0] * of_row[:, 0].max(initial=0.0))[:, None].astype(anchors.dtype)
    of_anchor, of_row = of_anchor.astype(anchors.dtype), of_row.astype(anchors.dtype)
    scores, room = np.zeros((n, m), dtype=anchors.dtype), np.empty((n, m), dtype=anchors.dtype)
    dimensions = np.arange(width)

    def add(start: int, end: int, cells: np.ndarray) -> None:
        """Scores of these dimensions, of the rows' ``cells`` alone."""
        part = np.where(cells, rows[:, start:end], 0)
        posting = np.flatnonzero(part.any(axis=1))
        if 2 * len(posting) >= m:
            np.add(scores, np.matmul(anchors[:, start:end], part.T, out=room), out=scores)
        elif len(posting):
            scores[:, posting] += anchors[:, start:end] @ part[posting].T

    def possible(upto: np.ndarray) -> np.ndarray:
        """Pairs that what lies behind the dimensions read so far can bring to the threshold."""
        if len(upto) and upto.min() == upto.max():
            np.multiply(of_anchor[:, upto[0], None], of_row[:, upto[0]], out=room)
        else:
            np.take(of_anchor, upto, axis=1, out=room, mode="clip")
            np.multiply(room, of_row[np.arange(m), upto], out=room)
        return np.add(room, scores, out=room) >= lowest

    read, alive = np.zeros(m, dtype=np.int64), np.ones((n, m), dtype=bool)
    for start in range(0, int(indexed.max(initial=0)), STEP):
        done = min(start + STEP, width)
        add(start, done, dimensions[start:done] < indexed[:, None])
        read = np.minimum(done, indexed)
        alive = possible(read)
        if np.count_nonzero(alive) <= FEW * alive.size:
            break
    else:
        if not indexed.any():
            alive = possible(read)
        if np.count_nonzero(alive) > FEW * alive.size:
            add(0, width, dimensions >= read[:, None])
            read, alive = np.full(m, width), scores >= lowest
    a, r = np.nonzero(alive)
    exact = scores[a, r]
    unread = np.flatnonzero(read[r] < width)
    for at in range(0, len(unread), 1 << 14):
        part = unread[at : at + (1 << 14)]
        exact[part] = np.einsum("ij,ij->i", anchors[a[part]], rows[r[part]])
    above = exact >= least[a]
    return a[above], r[above], exact[above]


def _dense(cells: tuple, n: int, width: int, kind: np.dtype) -> np.ndarray:
    table = np.zeros((n, width), dtype=kind)
    row, dimension, weight = cells
    inside = dimension < width  # the other table has zeros further on
    table[row[inside], dimension[inside]] = blocks.typed(weight[inside], kind)
    return table


class _Block:
    """A block of anchors or rows by label: ids, labels, cells, and their places in the order of ties."""

    def __init__(self, table: pa.Table, mark: str, factor: float):
        self.id, self.absent = blocks.ids(table, f"{mark}_id")
        self.label, _ = blocks.ids(table, f"{mark}_label")
        order = np.argsort(self.label, kind="stable")
        self.table = table.take(pa.array(order))
        self.id, self.absent, self.label = self.id[order], self.absent[order], self.label[order]
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[np.lexsort((self.id, self.absent))] = np.arange(len(order))
        self.cells = blocks.cells(self.table, factor)
        self.n = len(order)
        norms = blocks.norms(self.cells[0], self.cells[2], self.n)
        self.longest = float(norms.max(initial=0.0))
        self.width = int(self.cells[1].max(initial=-1)) + 1

    def part(self, a: int, b: int, width: int, kind: np.dtype) -> np.ndarray:
        x, y = np.searchsorted(self.cells[0], [a, b])
        row, dimension, weight = (c[x:y] for c in self.cells)
        return _dense((row - a, dimension, weight), b - a, width, kind)

    def tiles(self, size: int, by_label: bool) -> list[tuple[int, int]]:
        cuts = {0, self.n}
        if by_label:
            cuts |= set((np.flatnonzero(self.label[1:] != self.label[:-1]) + 1).tolist())
        cuts = sorted(cuts)
        return [
            (at, min(at + size, b))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            for at in range(a, b, size)
        ]


def _first(group: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each group are, ties by ``place``."""
    order = np.lexsort((place, -score, group))
    grouped = group[order]
    starts = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def _windows(floors: list, ceilings: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and largest score of each window, by anchor; nothing lies in a window that an anchor has not."""

    def bound(x: list | None, window: int, absent: int) -> int:
        return x[window] if x and window < len(x) else absent

    most = max((len(x or ()) for x in floors), default=0)
    return [
        tuple(np.array([bound(x, window, absent) for x in side]) for side, absent in ((floors, 1), (ceilings, 0)))
        for window in range(most)
    ]


def _join(group: blocks.Group, factor: float, k: int, same_label: bool) -> Iterator[pa.RecordBatch]:
    """The first k rows of each window of each anchor that reach its threshold, of this block."""
    anchors, rows = _Block(group.queries, "q", factor), _Block(group.rows, "r", factor)
    kind = blocks.kind_for(anchors.longest * rows.longest)
    width = min(anchors.width, rows.width)
    least = anchors.table["q_least"].to_numpy(zero_copy_only=False).astype(np.float64)
    least = np.where(np.isnan(least), -np.inf, least)
    number = anchors.table["q__row"].to_numpy()
    floors, ceilings = (anchors.table[c].to_pylist() for c in ("q_floors", "q_ceilings"))
    size = max(1, TILE_CELLS // max(width, 1))
    row_tiles = rows.tiles(size, same_label)
    for a, b in anchors.tiles(min(TILE_ANCHORS, size), same_label):
        left, label = anchors.part(a, b, width, kind), anchors.label[a:b]
        windows = _windows(floors[a:b], ceilings[a:b])
        kept: list[tuple] = []
        held = 0

        def cut(parts: list[tuple]) -> list[tuple]:
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
            best = _first(whole[0] * (1 << 20) + whole[1], rows.place[whole[2]], whole[3], k)
            return [tuple(x[best] for x in whole)]

        for c, d in row_tiles:
            if same_label and rows.label[c] != label[0]:
                continue
            anchor, row, score = threshold_scores(left, rows.part(c, d, width, kind), least[a:b])
            row = row + c
            own = (rows.id[row] == anchors.id[a + anchor]) & ~rows.absent[row] & ~anchors.absent[a + anchor]
            wanted = ~own & ((rows.label[row] == label[anchor]) == same_label)
            anchor, row, score = anchor[wanted], row[wanted], score[wanted]
            for window, (low, high) in enumerate(windows):
                inside = np.flatnonzero((score >= low[anchor]) & (score <= high[anchor]))
                inside = inside[_first(anchor[inside], rows.place[row[inside]], score[inside], k)]
                kept.append((anchor[inside], np.full(len(inside), window), row[inside], score[inside]))
                held += len(inside)
            if held > 1 << 16:
                kept = cut(kept)
                held = len(kept[0][0])
        if held:
            anchor, window, row, score = cut(kept)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number[a + anchor], pa.int64()),
                    pa.array(window, pa.int32()),
                    pa.array(rows.id[row], pa.int64(), mask=rows.absent[row]),
                    pa.array(blocks.longs(score), pa.int64()),
                ],
                names=["_anchor", "_window", "_id", "_score"],
            )


def _rounds(
    anchors: DataFrame, rows: DataFrame, steps: tuple, threshold, k: int, factor: float, same_label: bool
) -> DataFrame:
    """First k rows (_anchor, _window, _id, _score, _rank) of each window, over rounds of lower thresholds.

    ``threshold`` turns a step into the anchors' threshold; windows with a floor
    at or above it are settled whatever they hold.
    """
    order = Window.partitionBy("_anchor", "_window").orderBy(F.desc("_score"), F.asc_nulls_last("_id"))
    settled = []
    left = anchors
    for number, step in enumerate(steps):
        asking = left.withColumn("least", threshold(step))
        met = blocks.search(
            asking, rows, "v", ["id", "label", "least", "floors", "ceilings"], ["id", "label"],
            partial(_join, factor=factor, k=k, same_label=same_label), OUT,
        )
        ranked = met.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
        found = materialise(ranked, "met")
        last = number == len(steps) - 1
        if last:
            settled.append(found)
            break
        windows = asking.select(
            F.col(blocks.ROW).alias("_anchor"),
            "least",
            "wanted",
            "ceilings",
            F.posexplode("floors").alias("_window", "floor"),
        ).filter(F.col("floor") <= F.get("ceilings", F.col("_window")))
        counts = found.groupBy("_anchor", "_window").agg(F.count("*").alias("n"))
        open_ = (
            windows.filter(F.col("least").isNotNull() & (F.col("floor") < F.col("least")))
            .join(counts, ["_anchor", "_window"], "left")
            .filter(F.coalesce("n", F.lit(0)) < F.col("wanted"))
            .select("_anchor")
            .distinct()
        )
        open_ = materialise(open_, "open")
        settled.append(found.join(open_, "_anchor", "left_anti"))
        if open_.isEmpty():
            break
        left = left.join(open_.withColumnRenamed("_anchor", blocks.ROW), blocks.ROW, "left_semi")
        left = materialise(left, "anchors")
    return reduce(DataFrame.unionByName, settled)


def mine(
    table: DataFrame,
    is_anchor: Column,
    row_id: str,
    label: Column,
    vector: str,
    factor: float = 1.0,
    positives: int = 5,
    negatives: int = 3,
    floor: int = 50,
    ceiling: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(factor * x)``; the score is the inner product,
    higher first, ties by smaller id. An anchor's positives are its first other
    rows of its label; to each belong the first rows of other labels whose score
    is ``floor`` to ``ceiling`` hundredths of the positive's (none for a negative
    positive score).

    Rows without a label or a usable vector (null, or with a null or non-finite
    component) take no part; an empty vector scores 0. Rows with the anchor's id
    are its own and never found; a missing id stands last among ties. Repeated
    rows are rows of their own. An empty table, and a table of one label, give no
    rows. Other columns are neither read nor returned. A returned score beyond
    64 bits is an error.
    """
    usable = table.filter(blocks.usable(F.col(vector)))
    named = usable.select(
        F.col(row_id).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        F.col(vector).alias("v"),
    )
    rows = blocks.numbered(named.filter(F.col("label").isNotNull()), "labelled")
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * factor).cast("double"), F.lit(2)))
    sizes = rows.groupBy("label").agg(F.count("*").alias("size"))
    everything = (F.array(F.lit(-(1 << 63))), F.array(F.lit((1 << 63) - 1)))
    anchors = (
        rows.filter("asks")
        .join(sizes, "label")
        .select(
            blocks.ROW, "id", "label", "v", norm.alias("norm"),
            everything[0].alias("floors"), everything[1].alias("ceilings"),
            F.least(F.col("size") - 1, F.lit(positives)).alias("wanted"),
        )
    )
    anchors = materialise(anchors, "anchors")

    def of_norm(step: float | None) -> Column:
        return F.lit(None).cast("double") if step is None else F.col("norm") * F.lit(step)

    near = _rounds(anchors, rows, POSITIVE_STEPS, of_norm, positives, factor, True)
    near = materialise(near.select("_anchor", "_rank", "_id", "_score"), "positives")
    windows = near.groupBy(F.col("_anchor").alias(blocks.ROW)).agg(
        F.sort_array(F.collect_list(F.struct("_rank", "_score"))).alias("own")
    )  # at most ``positives`` entries
    low = F.transform("own", lambda x: F.ceil(x["_score"] * F.lit(floor).cast("decimal(3,0)") / 100).cast("long"))
    high = F.transform("own", lambda x: F.floor(x["_score"] * F.lit(ceiling).cast("decimal(3,0)") / 100).cast("long"))
    hunting = anchors.drop("floors", "ceilings", "wanted").join(windows, blocks.ROW).select(
        blocks.ROW, "id", "label", "v", low.alias("floors"), high.alias("ceilings"), F.lit(negatives).alias("wanted")
    )
    hunting = materialise(hunting.filter(F.exists("ceilings", lambda x: x >= 0)), "hunting")
    least_floor, least_ceiling = (F.array_min(F.filter(c, lambda x: x >= 0)) for c in ("floors", "ceilings"))

    def of_window(step: float | None) -> Column:
        bottom = least_floor.cast("double")
        return bottom if step is None else F.greatest(bottom, least_ceiling.cast("double") * F.lit(step))

    far = _rounds(hunting, rows, NEGATIVE_STEPS, of_window, negatives, factor, False)
    named = rows.filter("asks").select(F.col(blocks.ROW).alias("_anchor"), F.col("id").alias("anchor_id"))
    positive = near.select(
        "_anchor", (F.col("_rank") - 1).alias("_window"), F.col("_id").alias("positive_id"),
        F.col("_score").alias("positive_score"),
    )
    return (
        far.select("_anchor", "_window", F.col("_rank").alias("rank"), F.col("_id").alias("negative_id"), F.col("_score").alias("negative_score"))
        .join(positive, ["_anchor", "_window"])
        .join(named, "_anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
