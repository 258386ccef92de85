"""Extremely randomised trees (Geurts, Ernst and Wehenkel 2006), all trees grown together, level by level.

At a node, ``max_features`` of the features that vary there are drawn, and for each a threshold between the least and the largest value of the node's
rows; the best of these splits by impurity is taken. All draws come from hashes of seed, tree, node and feature, so the trees don't
depend on how rows are dealt to tasks. A level takes two passes over the rows: one for the ranges and class counts at
all open nodes of all trees, one for the class counts left of all drawn thresholds. Only numbers per open node travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import whole
from surveyloom.operators.classifiers.newton import counted_rows
from surveyloom.session import discard

#: Places (trees times rows) that a task holds at once.
PLACES = 1_000_000
DEEPEST = 30


@dataclass
class Nodes:
    """The nodes of all trees: the feature they test (-1: a leaf), threshold, children, and rows of both classes. Roots come first."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    heap: np.ndarray  # number of the node in its tree: 1 for the root, 2 i and 2 i + 1 below i
    tree: np.ndarray

    @classmethod
    def roots(cls, trees: int) -> Nodes:
        none = np.full(trees, -1)
        return cls(none, np.zeros(trees), none.copy(), none.copy(), np.zeros((trees, 2)), np.ones(trees, np.int64), np.arange(trees))

    def split(self, at: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Give the nodes ``at`` two children each; returns the new nodes."""
        new = len(self.feature) + np.arange(2 * len(at))
        self.feature[at], self.threshold[at], self.left[at], self.right[at] = feature, threshold, new[::2], new[1::2]
        none = np.full(len(new), -1)
        self.feature, self.threshold = np.concatenate([self.feature, none]), np.concatenate([self.threshold, np.zeros(len(new))])
        self.left, self.right = np.concatenate([self.left, none]), np.concatenate([self.right, none])
        self.counts = np.concatenate([self.counts, np.zeros((len(new), 2))])
        self.heap = np.concatenate([self.heap, np.repeat(2 * self.heap[at], 2) + np.tile([0, 1], len(at))])
        self.tree = np.concatenate([self.tree, np.repeat(self.tree[at], 2)])
        return new

    def route(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """The node that each row reaches in each of the trees: [trees, rows]."""
        at = np.repeat(trees[:, None], len(x), axis=1)
        rows = np.arange(len(x))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = x[rows, np.maximum(feature, 0)] > self.threshold[at]
            at = np.where(inner, np.where(right, self.right[at], self.left[at]), at)


def uniform_draws(seed: int, tree: np.ndarray, heap: np.ndarray, feature: np.ndarray | int, tag: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of the arguments."""
    with np.errstate(over="ignore"):
        x = np.full(np.broadcast_shapes(np.shape(tree), np.shape(heap), np.shape(feature)), np.uint64(seed * 4 + tag + 1))
        for part in (tree, heap, feature):
            x = (x ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x = x * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
    return ((x >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, y, *cols, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return np.column_stack(cols), y, n


def _visits(batches: Iterator[pa.RecordBatch], nodes: Nodes, place: np.ndarray, trees: np.ndarray) -> Iterator[tuple]:
    """(place of the open node, row, features, label, count) for all rows at open nodes, some trees and rows at a time."""
    for whole_batch in batches:
        step = max(1, PLACES // max(1, whole_batch.num_rows))
        x, y, n = _parts(whole_batch)
        for a in range(0, len(trees), step):
            at = place[nodes.route(x, trees[a : a + step])]
            tree, row = np.nonzero(at >= 0)
            yield at[tree, row], row, x, y, n


def _ranges(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, place, trees, opened, d = sent.value
        low, high, counts = np.full((opened, d), np.inf), np.full((opened, d), -np.inf), np.zeros((opened, 2))
        for at, row, x, y, n in _visits(batches, nodes, place, trees):
            for f in range(d):
                np.minimum.at(low[:, f], at, x[row, f])
                np.maximum.at(high[:, f], at, x[row, f])
            for k in (0, 1):
                counts[:, k] += np.bincount(at, n[row] * (y[row] == k), minlength=opened)
        seen = np.flatnonzero(counts.sum(axis=1))
        cols = [pa.array(seen.astype(np.int32)), *(pa.array(v[seen, k]) for v in (counts, low, high) for k in range(v.shape[1]))]
        yield pa.RecordBatch.from_arrays(cols, names=["node", *_names(d)])

    return run


def _names(d: int) -> list[str]:
    return ["n0", "n1", *(f"lo{f}" for f in range(d)), *(f"hi{f}" for f in range(d))]


def _lefts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, place, trees, feature, threshold = sent.value  # drawn splits: [open nodes, draws]
        opened, draws = feature.shape
        counts = np.zeros((opened, 2 * draws))
        for at, row, x, y, n in _visits(batches, nodes, place, trees):
            for c in range(draws):
                left = x[row, feature[at, c]] <= threshold[at, c]
                for k in (0, 1):
                    counts[:, 2 * c + k] += np.bincount(at, n[row] * (left & (y[row] == k)), minlength=opened)
        seen = np.flatnonzero(counts.any(axis=1))
        cols = [pa.array(seen.astype(np.int32)), *(pa.array(counts[seen, k]) for k in range(2 * draws))]
        yield pa.RecordBatch.from_arrays(cols, names=["node", *(f"c{k}" for k in range(2 * draws))])

    return run


def _gathered(rows: DataFrame, work, sent, sizes: tuple[int, int], aggregates: dict, empty: float = 0.0) -> np.ndarray:
    """The numbers per open node, summed (or the least, or the largest) over all tasks."""
    names = list(aggregates)
    schema = ", ".join(["node int", *(f"{c} double" for c in names)])
    table = rows.mapInArrow(work(sent), schema).groupBy("node").agg(*[how(c).alias(c) for c, how in aggregates.items()]).toArrow()  # a row per open node
    out = np.full(sizes, empty)
    out[table.column("node").to_numpy()] = np.column_stack([table.column(c).to_numpy() for c in names])
    return out


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Rows times impurity, from the rows of both classes in the last axis."""
    total = counts.sum(axis=-1)
    share = np.divide(counts, total[..., None], out=np.zeros_like(counts), where=total[..., None] > 0)
    if criterion == "gini":
        return total * (1 - (share**2).sum(axis=-1))
    return -total * (share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)


@dataclass
class RandomTrees:
    """Fitted trees; the probability is the mean share of class 1 at the leaves a row reaches."""

    features: list[str]
    nodes: Nodes
    trees: int

    def predict(self, df: DataFrame) -> DataFrame:
        share = self.nodes.counts[:, 1] / np.maximum(self.nodes.counts.sum(axis=1), 1e-300)
        sent = df.sparkSession.sparkContext.broadcast((self.nodes, share, self.trees))  # the size of the model

        @F.pandas_udf("double")
        def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            nodes, share, trees = sent.value
            for cols in batches:
                x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
                out = np.zeros(len(x))
                step = max(1, PLACES // max(1, len(x)))
                for a in range(0, trees, step):
                    out += share[nodes.route(x, np.arange(a, min(trees, a + step)))].sum(axis=0)
                yield pd.Series(out / trees)

        sound = [whole(F.col(c).cast("double"), self.features) for c in self.features]
        scored = df.withColumn("_p", probability(*sound))
        return scored.select(*df.columns, F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0).alias("prediction"), F.col("_p").alias("probability"))


def _wanted(max_features: str | int | float | None, d: int) -> int:
    if max_features in ("sqrt", "auto"):
        return max(1, int(math.sqrt(d)))
    if max_features == "log2":
        return max(1, int(math.log2(d)))
    if max_features is None or max_features == "all":
        return d
    if isinstance(max_features, float):
        return max(1, int(max_features * d))
    if isinstance(max_features, int) and max_features > 0:
        return min(max_features, d)
    raise ValueError(f"unknown max_features {max_features}")


def fit_extra_trees(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    n_estimators: int = 100,
    max_depth: int | None = None,
    min_samples_split: int = 2,
    min_samples_leaf: int = 1,
    max_features: str | int | float | None = "sqrt",
    criterion: str = "gini",
    seed: int = 1,
) -> RandomTrees:
    """Extremely randomised trees on all rows. No depth stands for ``DEEPEST``."""
    if n_estimators < 1 or min_samples_split < 2 or min_samples_leaf < 1:
        raise ValueError("n_estimators and min_samples_leaf must be at least 1, min_samples_split at least 2")
    if criterion not in ("gini", "entropy", "log_loss"):
        raise ValueError(f"unknown criterion {criterion}")
    features = list(features)
    d, depth = len(features), DEEPEST if max_depth is None else min(int(max_depth), DEEPEST)
    wanted = _wanted(max_features, d)
    spark = df.sparkSession
    rows = counted_rows(df, features, label)
    nodes = Nodes.roots(int(n_estimators))
    opened = np.arange(int(n_estimators))
    for level in range(depth + 1):
        place = np.full(len(nodes.feature), -1)
        place[opened] = np.arange(len(opened))
        trees = np.unique(nodes.tree[opened])
        kinds = {c: F.sum if c[0] == "n" else F.min if c[0] == "l" else F.max for c in _names(d)}
        sent = spark.sparkContext.broadcast((nodes, place, trees, len(opened), d))
        found = _gathered(rows, _ranges, sent, (len(opened), 2 + 2 * d), kinds)
        sent.unpersist()
        counts, low, high = found[:, :2], found[:, 2 : 2 + d], found[:, 2 + d :]
        nodes.counts[opened] = counts
        if not counts.sum():
            raise ValueError("no training rows")
        mixed = (counts.min(axis=1) > 0) & (counts.sum(axis=1) >= max(min_samples_split, 2 * min_samples_leaf)) & (low < high).any(axis=1)
        if level == depth or not mixed.any():
            break
        opened, counts, low, high = opened[mixed], counts[mixed], low[mixed], high[mixed]
        tree, heap = nodes.tree[opened][:, None], nodes.heap[opened][:, None]
        rank = np.where(low < high, uniform_draws(seed, tree, heap, np.arange(d), 0), 2.0)  # features that don't vary come last
        drawn = np.argsort(rank, axis=1, kind="stable")[:, :wanted]
        part = uniform_draws(seed, tree, heap, drawn, 1)
        at_low, at_high = np.take_along_axis(low, drawn, 1), np.take_along_axis(high, drawn, 1)
        threshold = np.minimum(at_low + part * (at_high - at_low), np.nextafter(at_high, -np.inf))
        place = np.full(len(nodes.feature), -1)
        place[opened] = np.arange(len(opened))
        sent = spark.sparkContext.broadcast((nodes, place, np.unique(tree), drawn, threshold))
        sums = {f"c{k}": F.sum for k in range(2 * drawn.shape[1])}
        left = _gathered(rows, _lefts, sent, (len(opened), 2 * drawn.shape[1]), sums).reshape(len(opened), -1, 2)
        sent.unpersist()
        right = counts[:, None, :] - left
        fits = (left.sum(axis=2) >= min_samples_leaf) & (right.sum(axis=2) >= min_samples_leaf) & (at_low < at_high)
        cost = np.where(fits, impurity(left, criterion) + impurity(right, criterion), np.inf)
        best = cost.argmin(axis=1)
        valid = np.flatnonzero(np.isfinite(cost.min(axis=1)))
        if not len(valid):
            break
        opened = nodes.split(opened[valid], drawn[valid, best[valid]], threshold[valid, best[valid]])
    discard(rows)
    return RandomTrees(features, nodes, int(n_estimators))
