"""Histogram boosting of all folds together.

Features are cut once into at most ``BINS`` quantile bins; a row is then one
byte per feature, and bin 0 stands for a missing value, which every split sends
to the side that gains more. Labelled rows with equal bins are alike to every tree:
those of one fold and label are merged by a grouping into a line with their number,
which weighs their gradients. Lines are written once, as blocks with one array per
column, and kept by the executors.

A level of a tree is one job for all folds: tasks add the gradients of their
rows per (fold, node, feature, bin), the sums of all tasks meet per (fold, node),
where the best cut is found, and only the best split of each node reaches the
driver. A node of few rows is not opened level by level: its rows go to one task,
which grows all below it. Folds do not wait for each other: one may open its
third level while another starts its next tree. Gradients are scaled integers, so the sums, and
with them the trees, do not depend on how the rows lie on tasks.

A table whose lines' bins take at most ``FOLD_BYTES`` is trained fold by fold, each fold
to its end by a task of its own: on so few lines a job for every tree costs far more
than the tree. The task merges lines with equal bins again, those of all other folds
and both labels. The trees are the same.

Trees grow best split first up to ``leaves``. A split's gain does not depend on
other leaves, so a level can be evaluated at once; nodes that ``leaves - 1``
others already precede are not opened. The job that starts a tree also
counts the held-out rows of its fold by score, for the AUC. Every ``WRITE_EVERY``
trees the margins are written to the shared folder, so no task has to apply
more trees than that, and a lost executor costs no more.

These jobs are the one place of the library that uses an RDD: there are some
thousand of them in a row, each of a few milliseconds on a small table, and
planning a DataFrame anew for each takes several times as long as its work.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from entityloom.session import materialise, release

BINS = 254  # without the one for missing values; a bin is one byte
PERCENTILE_ACCURACY = 2000
#: Gradients become multiples of 2^-20: sums of 2^32 rows stay exact in a double.
UNIT = float(1 << 20)
#: Lines of a written block.
BLOCK_ROWS = 1 << 16
#: Score steps between a fold's least and largest possible margin; ties inside a step count half.
AUC_STEPS = 1 << 14
WRITE_EVERY = 16
#: Histograms a task may hold; wider tables grow fewer folds in one job.
TASK_BYTES = 256 << 20
CELL_BYTES = 24
MERGE_BYTES = 8 << 20
#: Histograms of which a task finds the best cuts together.
AT_ONCE = 512
#: Nodes of at most so many rows are grown to their end by the one task that gets their rows.
LOCAL_ROWS = 4096
#: Tables whose lines have at most so many bytes of bins are trained by one task for each fold.
FOLD_BYTES = 16 << 20
#: Cells that are added up in one call.
CALL_CELLS = 1 << 20
CELLS = BINS + 2  # of one histogram: missing, the bins, and one for even division
BLOCKS = "label binary, fold binary, rows binary, bins binary, margins binary"


@dataclass(frozen=True)
class Rules:
    """How trees grow and when a fold ends."""

    trees: int
    leaves: int
    depth: int
    step: float
    patience: int
    feature_share: float
    l1: float
    l2: float
    least_gain: float
    least_weight: float
    least_rows: int
    seed: int


@dataclass
class Tree:
    """Nodes in order of creation; leaves have feature -1. Gains are of the node's own split."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, first in zip(self.columns(), (-1, 0, False, 0, 0, 0.0, 0.0), strict=True):
            column.append(first)
        return len(self.feature) - 1

    def columns(self) -> tuple[list, ...]:
        return self.feature, self.cut, self.missing_left, self.left, self.right, self.value, self.gain

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int32, np.int16, bool, np.int32, np.int32, np.float64)
        return tuple(np.array(c, dtype=k) for c, k in zip(self.columns(), kinds))  # noqa: B905 - no gains

    def splits(self) -> int:
        return sum(f >= 0 for f in self.feature)


def reach(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf, or node not yet split, that each row arrives at; ``bins`` has a line per feature."""
    feature, cut, missing_left, left, right = tree[:5]
    n = bins.shape[1]
    at = np.zeros(n, dtype=np.int32)
    moving = np.arange(n) if feature[0] >= 0 else np.zeros(0, dtype=np.int64)
    while len(moving):
        node = at[moving]
        value = bins[feature[node], moving]
        goes_left = np.where(value == 0, missing_left[node], value <= cut[node])
        at[moving] = np.where(goes_left, left[node], right[node])
        moving = moving[feature[at[moving]] >= 0]
    return at


def quantile_bounds(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature, at most ``BINS``; one aggregation for all."""
    shares = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS)])
    found = rows.agg(*[F.percentile_approx(f"`{c}`", shares, PERCENTILE_ACCURACY) for c in features]).first()
    return [np.unique(np.array(x if x is not None else [], dtype=np.float64)) for x in found]


def with_bins(rows: DataFrame, features: Sequence[str], bounds: Sequence[np.ndarray]) -> DataFrame:
    """The other columns and ``bins``: one byte per feature, 0 for missing and NaN."""
    kept = [c for c in rows.columns if c not in set(features)]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("bins", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(features)), dtype=np.uint8)
            for i, (name, limits) in enumerate(zip(features, bounds, strict=True)):
                column = batch.column(batch.schema.get_field_index(name))
                value = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
                if len(limits):
                    found = np.minimum(np.searchsorted(limits, value), len(limits) - 1) + 1
                    out[:, i] = np.where(np.isnan(value), 0, found)
            data = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            lines = pa.array([x.tobytes() for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*data, lines], names=[*kept, "bins"])

    return rows.mapInArrow(run, schema)


def _lines(column: pa.Array) -> np.ndarray:
    """Bins of the rows of a batch, with a line per feature."""
    raw = column.to_pylist()
    return np.ascontiguousarray(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1).T)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(g, h, rules: Rules):
    return _shrunk(g, rules.l1) ** 2 / (h + rules.l2)


def best_cuts(sums: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """Best (cut, missing_left, gain, left sums) of each node and feature, and all sums.

    ``sums`` holds per node and feature the gradient, weight and rows by bin, bin
    0 first. Equal gains go to the smaller cut of those with missing values on
    the right, then on the left; without an allowed cut the gain is minus infinity.
    """
    n = len(sums)
    total = sums.sum(axis=2)
    below = np.cumsum(sums[:, :, 1:], axis=2)
    whole = _score(total[:, 0], total[:, 1], rules)
    cut, side, gain, best_left = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, -np.inf), np.zeros((n, 3))
    for missing_left in (False, True):
        left = below + sums[:, :, :1] if missing_left else below
        right = total[:, :, None] - left
        fit = np.minimum(left[:, 2], right[:, 2]) >= max(rules.least_rows, 1)
        fit &= np.minimum(left[:, 1], right[:, 1]) >= rules.least_weight
        if missing_left:
            fit &= sums[:, 2, :1] > 0
        if not fit.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            both = _score(left[:, 0], left[:, 1], rules) + _score(right[:, 0], right[:, 1], rules)
        gains = np.where(fit, both - whole[:, None], -np.inf)
        at = gains.argmax(axis=1)
        found = gains[np.arange(n), at]
        better = np.flatnonzero(found > np.maximum(gain, rules.least_gain))
        cut[better], side[better], gain[better] = at[better] + 1, missing_left, found[better]
        best_left[better] = left[better, :, at[better]]
    return cut, side, gain, best_left, total


@dataclass
class _Fold:
    """What the driver knows of one fold."""

    number: int
    margin: float
    low: float
    high: float
    trees: list[Tree] = field(default_factory=list)
    best_auc: float = -1.0
    best: int = 0
    ended: bool = False

    def add(self, tree: Tree) -> None:
        leaves = [v for v, f in zip(tree.value, tree.feature, strict=True) if f < 0]
        self.low, self.high = self.low + min(leaves), self.high + max(leaves)
        self.trees.append(tree)

    def judge(self, auc: float, patience: int) -> None:
        if auc > self.best_auc:
            self.best_auc, self.best = auc, len(self.trees)
        self.ended = self.ended or len(self.trees) - self.best >= patience


@dataclass
class Model:
    """Trees of one fold up to its best, and the margin they start from."""

    fold: int
    margin: float
    trees: list[Tree]


def _applied(trees: Sequence[tuple], bins: np.ndarray, start: np.ndarray | float = 0.0) -> np.ndarray:
    """``start`` and the trees' values, added up one by one: the sum does not depend on when margins are written."""
    total = np.zeros(bins.shape[1]) + start
    for tree in trees:
        total += tree[5][reach(tree, bins)]
    return total


def merged_lines(rows: DataFrame) -> DataFrame:
    """``rows`` of equal bins, fold and label as one line each, with their number in ``n``."""
    return rows.groupBy("bins", "fold", "label").agg(F.count("*").alias("n"))


def _in_blocks(lines: DataFrame, margins: np.ndarray) -> DataFrame:
    """Blocks of lines with label, fold, rows and bins; every line starts with the folds' ``margins``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            label = table["label"].to_numpy().astype(np.uint8)
            fold = table["fold"].to_numpy().astype(np.int32)
            number = table["n"].to_numpy().astype(np.int64)
            bins = _lines(table["bins"])
            start = np.repeat(margins[:, None], len(label), axis=1)
            return _block_batch(label.tobytes(), fold.tobytes(), number.tobytes(), bins.tobytes(), start.tobytes())

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= BLOCK_ROWS:
                yield block()
                held = []
        if sum(x.num_rows for x in held):
            yield block()

    return lines.select("label", "fold", "n", "bins").mapInArrow(run, BLOCKS)


def _block_batch(*columns: bytes) -> pa.RecordBatch:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=names)


def _open_block(block, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    label = np.frombuffer(block[0], dtype=np.uint8)
    fold = np.frombuffer(block[1], dtype=np.int32)
    number = np.frombuffer(block[2], dtype=np.int64)
    bins = np.frombuffer(block[3], dtype=np.uint8).reshape(-1, len(label))
    return label, fold, number, bins, np.frombuffer(block[4], dtype=np.float64).reshape(folds, len(label))


class _Job:
    """The jobs over the written blocks."""

    def __init__(self, lines: DataFrame, start: np.ndarray, rules: Rules):
        self.folds, self.rules = len(start), rules
        self.pending: dict[int, list[tuple]] = {f: [] for f in range(self.folds)}
        self._keep(materialise(_in_blocks(lines, start), "margins"))

    def _keep(self, written: DataFrame) -> None:
        self.written = written
        self.blocks = written.rdd.map(tuple).persist()
        self.parts = self.blocks.getNumPartitions()

    def done(self) -> None:
        self.blocks.unpersist()
        release(self.written)

    def learn(self, fold: int, tree: Tree) -> None:
        self.pending[fold].append(tree.arrays())

    def write_margins(self) -> None:
        """Margins with all pending trees applied, as a new written table."""
        pending, folds = self.pending, self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    *_, bins, margins = _open_block(block, folds)
                    margins = margins.copy()
                    for fold, trees in pending.items():
                        margins[fold] = _applied(trees, bins, margins[fold])
                    yield _block_batch(*block[:4], margins.tobytes())

        following = materialise(self.written.mapInArrow(run, BLOCKS), "margins")
        self.done()
        self.pending = {f: [] for f in range(folds)}
        self._keep(following)

    def level(self, growing: dict[int, tuple], judged: dict[int, tuple[float, float]]) -> tuple[dict, dict]:
        """Best split by (fold, node), and the AUC by fold of ``judged``.

        ``growing`` has per fold the tree so far, the nodes to open, the features
        to try and the depth of the nodes of few rows; ``judged`` the least and
        largest margin.
        """
        rules = self.rules
        pending = {f: self.pending[f] for f in growing.keys() | judged.keys()}
        folds = self.folds

        def summed(blocks: Iterator[tuple]) -> Iterator[tuple]:
            held = {f: np.zeros((len(g[2]), 3, len(g[1]) * CELLS)) for f, g in growing.items()}
            scores = {f: np.zeros((2, AUC_STEPS), dtype=np.int64) for f in judged}
            for block in blocks:
                label, own, number, bins, margins = _open_block(block, folds)
                for fold, trees in pending.items():
                    margin = _applied(trees, bins, margins[fold])
                    if fold in judged:
                        scores[fold] += _by_score(margin, _by_label(label, number * (own == fold)), *judged[fold])
                    if fold in growing:
                        tree, nodes, features, small = growing[fold]
                        at = reach(tree, bins)
                        sums = _line_sums(margin, _by_label(label, number))
                        slot = np.full(len(tree[0]), -1)
                        slot[nodes] = np.arange(len(nodes))
                        _add(held[fold], np.where(own != fold, slot[at], -1), features, bins, sums)
                        for node in small:
                            lines = np.flatnonzero((at == node) & (own != fold))
                            yield (fold, node, SMALL), (bins[:, lines], np.array(sums)[:, lines])
            for fold, counts in scores.items():
                yield (fold, -1, -1), counts
            for fold, (_, nodes, features, _) in growing.items():
                for i, feature in enumerate(features):
                    whole = held[fold][i].astype(np.int64).reshape(3, len(nodes), CELLS)
                    for k, node in enumerate(nodes):
                        yield (fold, node, feature), whole[:, k]

        def best(found: Iterator[tuple]) -> Iterator[tuple]:
            chosen: dict[tuple, tuple] = {}
            held: list[tuple] = []

            def choose() -> None:
                for (fold, node, _), split in zip((k for k, _ in held), _chosen(held, rules), strict=True):
                    if (fold, node) not in chosen or split > chosen[fold, node]:
                        chosen[fold, node] = split
                held.clear()

            for key, total in found:
                if key[1] < 0:
                    yield key[:2], auc_of(total)
                    continue
                if key[2] == SMALL:
                    yield key[:2], _subtree(growing[key[0]][2], growing[key[0]][3][key[1]], *total, rules)
                    continue
                held.append((key, total))
                if len(held) == AT_ONCE:
                    choose()
            if held:
                choose()
            yield from chosen.items()

        if self.parts == 1:
            answers = self.blocks.mapPartitions(lambda x: best(_merged(summed(x))))
        else:
            cells = sum(len(g[1]) * len(g[2]) for g in growing.values()) * CELLS
            tasks = max(1, min(-(-cells * CELL_BYTES * self.parts // MERGE_BYTES), self.parts))
            met = self.blocks.mapPartitions(summed).reduceByKey(_together, tasks, _by_node)
            answers = met.mapPartitions(best)
        found = dict(answers.collect())  # one entry per fold and open node
        splits = {
            key: x if isinstance(x, dict) else Split(x[0], -x[1], *x[2:]) for key, x in found.items() if key[1] >= 0
        }
        return splits, {key[0]: x for key, x in found.items() if key[1] < 0}


#: Stands for the feature where the rows of a node come instead of their sums.
SMALL = -2


def _together(a, b):
    """Sums of two tasks added up; rows of two tasks side by side."""
    if isinstance(a, tuple):
        return tuple(np.concatenate(x, axis=1) for x in zip(a, b, strict=True))
    return a + b


def _merged(found: Iterator[tuple]) -> Iterator[tuple]:
    """What the blocks of a single task give, by key."""
    kept: dict[tuple, object] = {}
    for key, x in found:
        kept[key] = _together(kept[key], x) if key in kept else x
    yield from kept.items()


def _by_node(key: tuple) -> int:
    """All features of a node, and the scores of a fold, go to one task."""
    return key[0] * 8191 + key[1]


def _by_label(label: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rows of label 0 and of label 1 in each line."""
    return np.array([number * (label == y) for y in (0, 1)])


def _by_score(margin: np.ndarray, held_out: np.ndarray, low: float, high: float) -> np.ndarray:
    """Rows of label 0 and 1 per score step; ``held_out`` has those of each line."""
    place = np.floor((margin - low) / max(high - low, 1e-300) * AUC_STEPS)
    place = np.clip(place, 0, AUC_STEPS - 1).astype(np.int64)
    return np.array([np.bincount(place, n, AUC_STEPS) for n in held_out]).astype(np.int64)


def _gradients(margin: np.ndarray, label: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    chance = _chance(margin)
    return np.rint((chance - label) * UNIT), np.rint(chance * (1.0 - chance) * UNIT)


def _line_sums(margin: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and weight of all rows of each line, and their number; ``number`` has those of label 0 and 1."""
    (zero, h), (one, _) = _gradients(margin, 0), _gradients(margin, 1)
    n = number.sum(axis=0)
    return number[0] * zero + number[1] * one, n * h, n


def _add(held: np.ndarray, slot: np.ndarray, features: Sequence[int], bins: np.ndarray, sums: Sequence) -> None:
    """Add gradient, weight and rows per (feature, node, bin) of the lines with a slot."""
    used = np.flatnonzero(slot >= 0)
    if not len(used):
        return
    at, sums = slot[used] * CELLS, [x[used] for x in sums]
    for i, feature in enumerate(features):
        cell = at + bins[feature, used]
        for k, weights in enumerate(sums):
            held[i, k] += np.bincount(cell, weights, held.shape[2])


def _subtree(features: Sequence[int], depth: int, bins: np.ndarray, sums: np.ndarray, rules: Rules) -> dict:
    """All splits below a node from its lines: node -> (split, left, right), the node itself being 0."""
    growth = _grown(features, depth, bins, np.arange(bins.shape[1]), *sums[:2], rules, sums[2])
    tree = growth.tree
    whole = {n: (s, tree.left[n], tree.right[n]) for n, s in growth.known.items() if tree.feature[n] >= 0}
    return whole or {0: (growth.first, 0, 0)}


def _by_width(features: Sequence[int], bins: np.ndarray) -> list[tuple[int, list[int]]]:
    """(cells, places in ``features``) of features with about as many bins."""
    found: dict[int, list[int]] = {}
    for place, feature in enumerate(features):
        most = int(bins[feature].max()) if bins.shape[1] else 0
        found.setdefault(1 << most.bit_length(), []).append(place)
    return sorted(found.items())


def _histograms(
    features: Sequence[int], width: int, bins: np.ndarray, parts: Sequence[np.ndarray], sums: Sequence
) -> np.ndarray:
    """Gradient, weight and rows by [part of the lines, feature, sum, bin]."""
    rows = np.concatenate(parts)
    at = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) * width
    weights = [x[rows] for x in sums]
    out = np.empty((len(parts), len(features), 3, width))
    size = len(parts) * width
    step = max(1, CALL_CELLS // max(len(rows), 1))
    for first in range(0, len(features), step):
        some = features[first : first + step]
        cell = (bins[np.asarray(some)[:, None], rows] + at + size * np.arange(len(some))[:, None]).ravel()
        for k, w in enumerate(weights):
            total = np.bincount(cell, np.tile(w, len(some)), size * len(some))
            out[:, first : first + step, k] = total.reshape(len(some), len(parts), width).transpose(1, 0, 2)
    return out


def _best_splits(features: Sequence[int], classes: list[tuple[int, list[int]]], sums: list[np.ndarray], rules: Rules):
    """The best split of each node; the smaller feature of equal gains. ``sums`` holds one array per class."""
    found: list[np.ndarray] = []
    nodes = len(sums[0])
    order = [place for _, places in classes for place in places]
    for held in sums:
        scaled = held.reshape(-1, 3, held.shape[3]).copy()
        scaled[:, :2] /= UNIT
        cut, side, gain, left, total = best_cuts(scaled, rules)
        found.append(np.column_stack([gain, cut, side, left, total]).reshape(nodes, -1, 9))
    every = np.concatenate(found, axis=1)[:, np.argsort(order)]
    best = every[:, :, 0].argmax(axis=1)
    lines = every[np.arange(nodes), best].tolist()
    return [
        Split(x[0], int(features[i]), int(x[1]), bool(x[2]), *x[3:]) for i, x in zip(best.tolist(), lines, strict=True)
    ]


def _grown(
    features: Sequence[int], depth: int, bins: np.ndarray, rows: np.ndarray, g, h, rules: Rules, n=None
) -> _Growth:
    """The tree, or part of one, that the numbered lines ``rows`` grow; ``n`` has the rows of each line, else it is one.

    A feature with one bin alone has no split and is not looked at.

    Of two children only the smaller is counted; the sums are whole numbers, so
    those of the other are exactly the rest.
    """
    features = [f for f in features if bins[f].min(initial=255) < bins[f].max(initial=0)] or features[:1]
    growth = _Growth(list(features), depth)
    sums = g, h, np.ones(len(g)) if n is None else n
    classes = _by_width(features, bins)
    inside = {0: rows}
    held: dict[int, list[np.ndarray]] = {}
    counted, rest = [0], {}
    while growth.open:
        made = [
            _histograms([features[i] for i in places], width, bins, [inside[n] for n in counted], sums)
            for width, places in classes
        ]
        now = {n: [x[i] for x in made] for i, n in enumerate(counted)}
        now |= {n: [a - b for a, b in zip(held[up], now[other], strict=True)] for n, (up, other) in rest.items()}
        together = [np.stack(x) for x in zip(*(now[n] for n in growth.open), strict=True)]
        opened = growth.open
        found = _best_splits(features, classes, together, rules)
        growth.take(dict(zip(opened, found, strict=True)), rules)
        held, counted, rest, wanted = now, [], {}, set(growth.open)
        tree = growth.tree
        for node in opened:
            if tree.feature[node] < 0:
                continue
            own = inside.pop(node)
            children = tree.left[node], tree.right[node]
            if not wanted.intersection(children):
                continue
            value = bins[tree.feature[node], own]
            left = np.where(value == 0, tree.missing_left[node], value <= tree.cut[node])
            inside[children[0]], inside[children[1]] = own[left], own[~left]
            less, more = sorted(children, key=lambda c: len(inside[c]))
            counted.append(less)
            if more in wanted:
                rest[more] = node, less
    return growth


class Split(NamedTuple):
    """The best split of a node: sums of the left side and of all its rows."""

    gain: float
    feature: int
    cut: int
    missing_left: bool
    g_left: float
    h_left: float
    n_left: float
    g_all: float
    h_all: float
    n_all: float


def _chosen(found: Sequence[tuple], rules: Rules) -> list[tuple]:
    """A split for each ((fold, node, feature), sums), to be compared: gain first, then the smaller feature."""
    scaled = np.array([sums[:, : BINS + 1] for _, sums in found], dtype=np.float64)
    scaled[:, :2] /= UNIT
    cut, side, gain, left, total = (x.tolist() for x in best_cuts(scaled, rules))
    features = (-key[2] for key, _ in found)
    return [(g, f, c, m, *x, *y) for g, f, c, m, x, y in zip(gain, features, cut, side, left, total, strict=True)]


def auc_of(counts: np.ndarray) -> float:
    """AUC of counts of 0 and 1 labels by ascending score; 0.5 where a class is absent."""
    kind = np.int64 if int(counts.sum()) < 1 << 31 else object  # products of rows stay exact
    zeros, ones = (x.astype(kind) for x in counts[:, counts.any(axis=0)])
    if not zeros.sum() or not ones.sum():
        return 0.5
    below = np.cumsum(zeros) - zeros
    return float((ones * (2 * below + zeros)).sum()) / float(2 * zeros.sum() * ones.sum())


class _Growth:
    """One tree of one fold while it grows; or the tree below a node at some depth."""

    def __init__(self, features: list[int], depth: int = 0, rows: float = math.inf):
        self.features = features
        self.tree = Tree()
        self.depth = [depth]
        self.rows = [rows]
        self.known: dict[int, Split] = {}
        self.totals: dict[int, tuple] = {}
        self.open = [0]
        self.first: Split | None = None

    def asked(self) -> tuple:
        """What a job needs: the tree, nodes to open by sums, features, nodes to grow whole and their depth."""
        small = {n: self.depth[n] for n in self.open if self.rows[n] <= LOCAL_ROWS}
        return self.tree.arrays(), [n for n in self.open if n not in small], self.features, small

    def _split(self, node: int, s: Split) -> tuple[int, int]:
        tree = self.tree
        tree.feature[node], tree.cut[node], tree.missing_left[node] = s.feature, s.cut, s.missing_left
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        sides = (s.g_left, s.h_left, s.n_left), (s.g_all - s.g_left, s.h_all - s.h_left, s.n_all - s.n_left)
        for child, (g, h, n) in zip((tree.left[node], tree.right[node]), sides, strict=True):
            self.depth.append(self.depth[node] + 1)
            self.rows.append(n)
            self.totals[child] = (g, h)
        return tree.left[node], tree.right[node]

    def take(self, splits: dict[int, object], rules: Rules) -> None:
        """What was found for the open nodes; opens the children that can still count."""
        grown: dict[int, dict] = {}
        for node in self.open:
            s = splits.get(node)
            if isinstance(s, dict):
                grown[node] = s
                s = s[0][0]
            self.first = self.first or s
            self.totals.setdefault(node, (s.g_all, s.h_all) if s else (0.0, 0.0))  # no split: no row to learn from
            if s and s.gain > rules.least_gain:
                self.known[node] = s
        for node, below in grown.items():  # whole trees need no further opening
            names = {0: node}
            for inner in sorted(below):
                s, left, right = below[inner]
                if s.gain > rules.least_gain:
                    self.known[names[inner]] = s
                    names[left], names[right] = self._split(names[inner], s)
        opened = []
        wanted = self.best_first(rules)
        for node in self.open:
            if node not in wanted or node in grown:
                continue
            for child in self._split(node, self.known[node]):
                room = self.rows[child] >= 2 * rules.least_rows and self.totals[child][1] >= 2 * rules.least_weight
                if self.depth[child] < rules.depth and room:
                    opened.append(child)
        self.open = opened

    def best_first(self, rules: Rules) -> set[int]:
        """The first ``leaves - 1`` splits by gain; those still unknown can only put others off."""
        chosen: set[int] = set()
        ready = [(-self.known[0].gain, 0)] if 0 in self.known else []
        while ready and len(chosen) < rules.leaves - 1:
            node = heapq.heappop(ready)[1]
            chosen.add(node)
            if self.tree.feature[node] >= 0:
                for child in (self.tree.left[node], self.tree.right[node]):
                    if child in self.known:
                        heapq.heappush(ready, (-self.known[child].gain, child))
        return chosen

    def finished(self, rules: Rules) -> Tree:
        """The tree with its first splits and the leaves' values."""
        chosen = self.best_first(rules)
        out, names = Tree(), {0: 0}
        for node in range(len(self.tree.feature)):
            if node not in names:
                continue
            here = names[node]
            g, h = self.totals[node]
            out.value[here] = float(-_shrunk(g, rules.l1) / (h + rules.l2) * rules.step) if h + rules.l2 > 0 else 0.0
            if node in chosen:
                out.feature[here], out.cut[here] = self.tree.feature[node], self.tree.cut[node]
                out.missing_left[here], out.gain[here] = self.tree.missing_left[node], self.known[node].gain
                out.left[here], out.right[here] = out.add(), out.add()
                names[self.tree.left[node]], names[self.tree.right[node]] = out.left[here], out.right[here]
        return out


def tried_features(width: int, rules: Rules, fold: int, tree: int) -> list[int]:
    """The share of features that one tree may split on."""
    n = min(width, max(round(width * rules.feature_share), min(2, width)))
    return sorted(np.random.default_rng([rules.seed, fold, tree]).permutation(width)[:n].tolist())


def _group(folds: list[_Fold], width: int, rules: Rules) -> list[list[_Fold]]:
    """Folds that grow in one job, so that a task's histograms stay within bounds."""
    each = 2 * rules.leaves * width * CELLS * CELL_BYTES
    size = max(1, TASK_BYTES // each)
    return [folds[i : i + size] for i in range(0, len(folds), size)]


def boost(rows: DataFrame, width: int, folds: int, rules: Rules) -> list[Model]:
    """One model per fold, from ``rows`` with label, fold and bins.

    Fold ``f`` learns from the rows of other folds and ends when ``patience``
    trees have brought its own rows no higher AUC, or when no split is left.
    """
    lines = materialise(merged_lines(rows), "lines")
    found = lines.groupBy("fold", "label").agg(F.sum("n").alias("n"), F.count("*").alias("lines")).collect()
    counts = {(r.fold, r.label): r.n for r in found}
    state, learning = [], {}
    for fold in range(folds):
        n, ones = (
            sum(v for (f, y), v in counts.items() if f != fold and (y == 1 or every)) for every in (True, False)
        )
        learning[fold] = n
        share = min(max(ones / n if n else 0.5, 1e-12), 1 - 1e-12)
        margin = math.log(share / (1 - share))
        state.append(_Fold(fold, margin, margin, margin, ended=not n))
    start = np.array([s.margin for s in state])
    if sum(r.lines for r in found) * width <= FOLD_BYTES:
        models = _each_fold_at_once(lines, width, start, rules)
        release(lines)
        return models
    job = _Job(lines, start, rules)
    release(lines)
    growths: dict[int, _Growth] = {}
    while going := [s for s in state if not s.ended]:
        for group in _group(going, width, rules):
            judged = {}
            for s in group:
                if s.number not in growths:
                    features = tried_features(width, rules, s.number, len(s.trees))
                    growths[s.number] = _Growth(features, 0, learning[s.number])
                    judged |= {s.number: (s.low, s.high)} if s.trees else {}
            grows = {s.number: growths[s.number] for s in group if len(s.trees) < rules.trees}
            growing = {f: g.asked() for f, g in grows.items()}
            splits, auc = job.level(growing, judged)
            for s in group:
                if s.number in auc:
                    s.judge(auc[s.number], rules.patience)
                s.ended = s.ended or s.number not in grows
                if s.ended:
                    continue
                growth = growths[s.number]
                growth.take({n: splits.get((s.number, n)) for n in growth.open}, rules)
                if not growth.open:
                    tree = growths.pop(s.number).finished(rules)
                    s.ended = not tree.splits()
                    if tree.splits():
                        s.add(tree)
                        job.learn(s.number, tree)
        if max(map(len, job.pending.values())) >= WRITE_EVERY:
            job.write_margins()
    job.done()
    return [Model(s.number, s.margin, s.trees[: s.best]) for s in state]


def _each_fold_at_once(lines: DataFrame, width: int, start: np.ndarray, rules: Rules) -> list[Model]:
    """The models of a table of bounded size: one task grows all trees of a fold."""
    folds = len(start)
    written = materialise(_in_blocks(lines, start[:0]), "blocks")

    def whole(blocks: Iterator[tuple]) -> Iterator[Model]:
        held: dict[int, list] = {}
        for fold, block in blocks:
            held.setdefault(fold, []).append(_open_block(block, 0)[:4])
        for fold, opened in held.items():
            label, own, number, bins = (np.concatenate(x, axis=-1) for x in zip(*opened, strict=True))
            yield _whole_fold(fold, float(start[fold]), label, own == fold, number, bins, rules)

    copies = written.rdd.map(tuple).flatMap(lambda block: [(fold, block) for fold in range(folds)])
    models = copies.partitionBy(folds, int).mapPartitions(whole).collect()  # one per fold
    release(written)
    made = {m.fold: m for m in models}
    return [made.get(f, Model(f, float(start[f]), [])) for f in range(folds)]


def _distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different lines of ``bins``, and which of them each one is."""
    lines = np.ascontiguousarray(bins.T)
    whole = lines.view(np.dtype((np.void, lines.shape[1]))).ravel()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    return np.ascontiguousarray(bins[:, first]), which


def _whole_fold(fold: int, margin: float, label, held_out, number, bins: np.ndarray, rules: Rules) -> Model:
    """All trees of one fold up to its best."""
    bins, line = _distinct(bins)
    learning, judging = (
        np.array([np.bincount(line, n, bins.shape[1]) for n in _by_label(label, number * inside)])
        for inside in (~held_out, held_out)
    )
    learnt = np.flatnonzero(learning.any(axis=0))
    s = _Fold(fold, margin, margin, margin, ended=not len(learnt))
    margins = np.full(bins.shape[1], margin)
    while not s.ended:
        if s.trees:
            s.judge(auc_of(_by_score(margins, judging, s.low, s.high)), rules.patience)
        if s.ended or len(s.trees) >= rules.trees:
            break
        features = tried_features(len(bins), rules, fold, len(s.trees))
        g, h, n = _line_sums(margins, learning)
        tree = _grown(features, 0, bins, learnt, g, h, rules, n).finished(rules)
        if not tree.splits():
            break
        s.add(tree)
        margins = _applied([tree.arrays()], bins, margins)
    return Model(fold, margin, s.trees[: s.best])


class Forest(NamedTuple):
    """The trees of one fold for scoring: the columns of all their nodes, and where each tree's nodes end."""

    margin: float
    ends: np.ndarray
    nodes: tuple[np.ndarray, ...]

    def trees(self) -> list[tuple[np.ndarray, ...]]:
        starts = [0, *self.ends[:-1].tolist()]
        return [tuple(x[a:b] for x in self.nodes) for a, b in zip(starts, self.ends.tolist(), strict=False)]


def scored(rows: DataFrame, forests: dict[int, Forest], own: bool) -> DataFrame:
    """``bins`` replaced by ``score``: of the model of the row's ``fold``, or the mean of all.

    Rows with equal bins have equal scores, so every different line is scored once.
    """
    lines = ["fold", "bins"] if own else ["bins"]
    kept = [c for c in rows.columns if c != "bins"]
    schema = T.StructType([*[rows.schema[c] for c in lines], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _lines(batch.column(batch.schema.get_field_index("bins")))
            score = np.zeros(batch.num_rows)
            for fold, forest in forests.items():
                if own:
                    number = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
                    mine = np.flatnonzero(number == fold)
                    if len(mine):
                        score[mine] = _chance(_applied(forest.trees(), bins[:, mine], forest.margin))
                else:
                    score += _chance(_applied(forest.trees(), bins, forest.margin))
            data = [batch.column(batch.schema.get_field_index(c)) for c in lines]
            done = pa.array(score if own else score / len(forests), pa.float64())
            yield pa.RecordBatch.from_arrays([*data, done], names=[*lines, "score"])

    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Lines of a fold lie side by side, so that a task works on few folds.
    different = rows.select(*lines).distinct().repartitionByRange(parallel, *lines)
    return rows.join(different.mapInArrow(run, schema), lines).select(*kept, "score")


TREES = (
    "fold int, margin double, tree int, feature array<int>, cut array<int>, missing_left array<boolean>, "
    "left array<int>, right array<int>, value array<double>, gain array<double>"
)
COLUMNS = ("feature", "cut", "missing_left", "left", "right", "value", "gain")


def as_rows(models: Sequence[Model]) -> list[tuple]:
    """Models as rows of TREES, a row for each tree; a model without trees is one row with no tree."""
    out = []
    for m in models:
        out += [(m.fold, m.margin, *[None] * 8)] if not m.trees else []
        out += [(m.fold, m.margin, number, *tree.columns()) for number, tree in enumerate(m.trees)]
    return out


def as_table(models: Sequence[Model]) -> pa.Table:
    """``as_rows`` for Arrow, which takes nodes over column by column."""
    kinds = [pa.int32(), pa.float64(), pa.int32()]
    kinds += [pa.list_(k) for k in (pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 2, *[pa.float64()] * 2)]
    columns = zip(*as_rows(models), strict=True)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["fold", "margin", "tree", *COLUMNS])


def from_rows(rows: Sequence) -> list[Model]:
    """The models of rows of TREES in any order."""
    models: dict[int, Model] = {}
    for r in sorted(rows, key=lambda r: (r["fold"], r["tree"] or 0)):
        model = models.setdefault(r["fold"], Model(r["fold"], r["margin"], []))
        if r["tree"] is not None:
            model.trees.append(Tree(*[list(r[name]) for name in COLUMNS]))
    return [models[f] for f in sorted(models)]


def forests(table: pa.Table) -> dict[int, Forest]:
    """The trees of each fold, from rows of TREES in any order."""
    table = table.sort_by([("fold", "ascending"), ("tree", "ascending")])
    number = table["fold"].to_numpy()
    found = {}
    for fold in np.unique(number).tolist():
        first, end = np.searchsorted(number, [fold, fold + 1]).tolist()
        own = table.slice(first, end - first)
        grown = own.filter(own["tree"].is_valid())
        columns = [grown[c].combine_chunks() for c in COLUMNS[:6]]
        kinds = (np.int32, np.int16, bool, np.int32, np.int32, np.float64)
        nodes = tuple(c.flatten().to_numpy(zero_copy_only=False).astype(k) for c, k in zip(columns, kinds, strict=True))
        ends = np.cumsum(columns[0].value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        found[fold] = Forest(own["margin"][0].as_py(), ends, nodes)
    return found
