"""Extremely randomised trees, grown level by level: all trees at once, one grouped aggregate a level.

A node draws a few features and, for each, one threshold evenly between the feature's least and greatest value in the node; the best
of these splits is taken. No row is sampled. Per level, every task finds the rows' nodes in all trees and adds up, for each drawn split,
what lies on either side: counts, sums of the targets, and the ranges of all features, from which the next level draws. What comes to the
driver is a row for each drawn split of a level, and the trees themselves; both are bounded by trees, depth and draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, DEPTH, LEAST_LEAF, SEED = 20, 10, 5, 42


@dataclass
class Node:
    """A node by its number (the root is 1, children are 2 i and 2 i + 1): what is in it, and its split if it has one."""

    n: int
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray
    splits: list[tuple[int, float]] = field(default_factory=list)
    chosen: tuple[int, float] | None = None


@dataclass(frozen=True)
class ExtraTrees:
    """Trees as arrays by node number: the feature split on (-1 for a leaf), the threshold, and the mean target."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def nodes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of every row."""
        at = np.ones(len(x), np.int64)
        while True:
            f = self.features[tree, at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            own = at[inner]
            at[inner] = 2 * own + (x[inner, f[inner]] > self.thresholds[tree, own])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean targets, a row for each row."""
        return sum(self.values[t, self.nodes(x, t)] for t in range(len(self.features))) / len(self.features)


def draws(seed: int, tree: int, number: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, float]]:
    """Up to k features that are not constant in the node, each with a threshold in its range."""
    rng = np.random.default_rng([seed, tree, number])
    vary = np.flatnonzero(high > low)
    picked = rng.permutation(vary)[:k]
    return [(int(f), float(low[f] + rng.random() * (high[f] - low[f]))) for f in picked]


def _ready(node: Node, seed: int, tree: int, number: int, k: int, least: int, depth: int) -> bool:
    """Draws a node's splits if it may have one."""
    if number.bit_length() <= depth and node.n >= 2 * least:
        node.splits = draws(seed, tree, number, node.low, node.high, k)
    return bool(node.splits)


def best_split(parts: list[tuple[int, int, np.ndarray, np.ndarray]], least: int) -> int | None:
    """Which of some splits, as (rows left, rows right, sums left, sums right), leaves the least spread of the targets; the first of equal ones."""
    gains = [-np.inf if min(a, b) < least else float((s * s).sum() / a + (r * r).sum() / b) for a, b, s, r in parts]
    best = int(np.argmax(gains)) if gains else 0
    return best if gains and np.isfinite(gains[best]) else None


def _sides(x: np.ndarray, y: np.ndarray, n: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(slot, rows, sums, least and greatest values) of each slot that has rows; a row stands for ``n``."""
    order = np.argsort(slot, kind="stable")
    own = slot[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    xs, ns = x[order], n[order]
    ys = y[order] * ns[:, None]
    yield from zip(own[starts].tolist(), np.add.reduceat(ns, starts).tolist(), np.add.reduceat(ys, starts), np.minimum.reduceat(xs, starts), np.maximum.reduceat(xs, starts), strict=True)


_SIDES = "tree int, node int, split int, side int, n long, sums array<double>, low array<double>, high array<double>"


def _level(shared):
    """Rows (x, y) to what lies on either side of each drawn split; split -1 is all of a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, level = shared.value
        total: dict[tuple[int, int, int, int], list] = {}

        def add(key, n, sums, low, high):
            if key in total:
                own = total[key]
                own[0] += n
                own[1] = own[1] + sums
                own[2], own[3] = np.minimum(own[2], low), np.maximum(own[3], high)
            else:
                total[key] = [n, sums, low, high]

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (0, 1))
            n = batch.column(2).to_numpy()
            if model is None:
                for _, *found in _sides(x, y, n, np.zeros(len(x), np.int64)):
                    add((0, 1, -1, 0), *found)
                continue
            for tree, splits in level.items():  # node -> splits
                at = model.nodes(x, tree)
                for s in range(max(map(len, splits.values()))):
                    feature, threshold = np.full(model.features.shape[1], -1), np.zeros(model.features.shape[1])
                    for number, own in splits.items():
                        if s < len(own):
                            feature[number], threshold[number] = own[s]
                    rows = np.flatnonzero(feature[at] >= 0)
                    if len(rows):
                        own = at[rows]
                        side = (x[rows, feature[own]] > threshold[own]).astype(np.int64)
                        for slot, *found in _sides(x[rows], y[rows], n[rows], 2 * own + side):
                            add((tree, slot >> 1, s, slot & 1), *found)
        if total:
            keys, parts = zip(*total.items(), strict=True)
            ints = [pa.array(c, pa.int32()) for c in zip(*keys, strict=True)]
            n, *lists = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays([*ints, pa.array(n, pa.int64()), *(pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in lists)], [c.split()[0] for c in _SIDES.split(", ")])

    return run


def _merged(found: DataFrame, classes: int, features: int) -> DataFrame:
    each = lambda name, n, f: F.array(*(f(F.col(name)[i]) for i in range(n))).alias(name)
    return found.groupBy("tree", "node", "split", "side").agg(F.sum("n").alias("n"), each("sums", classes, F.sum), each("low", features, F.min), each("high", features, F.max))


def fit(rows: DataFrame, classes: int = 1, trees: int = TREES, depth: int = DEPTH, least_leaf: int = LEAST_LEAF, k: int | None = None, seed: int = SEED) -> ExtraTrees:
    """Trees over (x array<double>, y array<double>): y is one number, or a 1 among 0s for a class; rows hold no nulls. ``k`` features are drawn at
    a node, by default the root of their number for classes and all of them for numbers. A row with ``n`` stands for so many equal ones, and gives
    the trees that they would."""
    spark = rows.sparkSession
    rows = rows.select("x", "y", F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long").alias("n"))
    root = _merged_root(rows, classes)
    if root is None:
        raise ValueError("no rows to learn from")
    features = len(root.low)
    k = k or (features if classes == 1 else max(1, round(features**0.5)))
    grown: list[dict[int, Node]] = [{1: Node(root.n, root.sums, root.low, root.high)} for _ in range(trees)]
    waiting = {t: {1: own[1].splits} for t, own in enumerate(grown) if _ready(own[1], seed, t, 1, k, least_leaf, depth)}
    while waiting:
        shared = spark.sparkContext.broadcast((_arrays(grown, depth, classes), waiting))
        found = _merged(rows.mapInArrow(_level(shared), _SIDES), classes, features).collect()  # a row for each side of each drawn split
        sides = {(r.tree, r.node, r.split, r.side): r for r in found}
        shared.unpersist()
        following: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for tree, own in waiting.items():
            for number, splits in own.items():
                both = [(sides.get((tree, number, s, 0)), sides.get((tree, number, s, 1))) for s in range(len(splits))]
                none = np.zeros(classes)
                parts = [(a.n if a else 0, b.n if b else 0, np.array(a.sums) if a else none, np.array(b.sums) if b else none) for a, b in both]
                best = best_split(parts, least_leaf)
                if best is None:
                    continue
                grown[tree][number].chosen = splits[best]
                for side, r in enumerate(both[best]):
                    child = grown[tree][2 * number + side] = Node(r.n, np.array(r.sums), np.array(r.low), np.array(r.high))
                    if _ready(child, seed, tree, 2 * number + side, k, least_leaf, depth):
                        following.setdefault(tree, {})[2 * number + side] = child.splits
        waiting = following
    return _arrays(grown, depth, classes)


def _merged_root(rows: DataFrame, classes: int) -> Node | None:
    first = rows.select(F.size("x").alias("f")).first()
    if first is None:
        return None
    shared = rows.sparkSession.sparkContext.broadcast((None, None))
    r = _merged(rows.mapInArrow(_level(shared), _SIDES), classes, first.f).first()
    return Node(r.n, np.array(r.sums), np.array(r.low), np.array(r.high))


def _arrays(grown: list[dict[int, Node]], depth: int, classes: int) -> ExtraTrees:
    size = 2 << depth
    features, thresholds, values = np.full((len(grown), size), -1), np.zeros((len(grown), size)), np.zeros((len(grown), size, classes))
    for t, own in enumerate(grown):
        for number, node in own.items():
            values[t, number] = node.sums / node.n
            if node.chosen:
                features[t, number], thresholds[t, number] = node.chosen
    return ExtraTrees(features, thresholds, values)


def predict(model: ExtraTrees, rows: DataFrame) -> DataFrame:
    """The rows, which have x array<double>, with ``prediction``: the mean target, or the class with the largest one."""
    shared, at = rows.sparkSession.sparkContext.broadcast(model), rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
            made = shared.value.predict(x) if batch.num_rows else np.zeros((0, 1))
            out = made[:, 0] if made.shape[1] == 1 else made.argmax(1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "prediction"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, prediction double")
