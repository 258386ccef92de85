"""Gradient-boosted trees (Friedman 2002) over counted rows.

Rows are placed between the thresholds of each feature, and equal rows become one counted row. They are held in memory, a block of arrays per task,
with their margins. In a pass tasks add up counts and residuals per open node and joint place of some features, and the driver takes the
best splits of the sums. The sums over the joint places of all sets of k features hold what k levels need; k is the largest number whose sums stay below
``CELLS``, so features of few values take one pass per tree, others one per level. Every ``KEPT`` trees the margins are brought up to date and checkpointed; in between, passes add the last few trees.

The share of rows that a tree sees is drawn for each copy of a counted row, by generators of seed, tree and block of the rows' hash; so neither the draws nor
the trees depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import whole
from surveyloom.operators.classifiers.boosted_stumps import cut_points, placed_rows
from surveyloom.operators.classifiers.random_trees import PLACES, Nodes, uniform_draws
from surveyloom.session import discard, keep_checkpoints

#: A feature with more distinct values is cut at so many quantiles.
BINS = 64
#: Blocks of the rows' hash: the unit of random draws, and the most tasks.
BLOCKS = 256
#: Counted rows that a task should have, and the most of them.
FEW, MANY = 2_000, 500_000
#: Nodes times joint places in one pass.
CELLS = 1 << 14
#: Trees between two states of the margins.
KEPT = 20


@dataclass(frozen=True)
class Plan:
    """What a task needs to know: the size of the model, the draws, and the places of each feature."""

    trees: int
    depth: int
    rate: float
    subsample: float
    wanted: int  # features drawn per node
    gamma: float
    seed: int
    places: tuple[int, ...]
    tolerance: float | None  # stop on held rows


@dataclass
class PackedTrees:
    """All nodes of a boosted model in arrays; ``value`` is what a leaf adds to the margin."""

    features: list[str]
    nodes: Nodes
    value: np.ndarray
    trees: int

    def additions(self, x: np.ndarray) -> np.ndarray:
        """What each tree adds for each row: [rows, trees]."""
        out = np.empty((len(x), self.trees))
        step = max(1, PLACES // max(1, len(x)))
        for a in range(0, self.trees, step):
            out[:, a : a + step] = self.value[self.nodes.route(x, np.arange(a, min(self.trees, a + step)))].T
        return out

    def prefix(self, trees: int) -> PackedTrees:
        """The model of the first trees."""
        return PackedTrees(self.features, self.nodes, self.value, trees)

    def _scored(self, df: DataFrame, kind: str, last: bool, name: str) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)  # the size of the model

        @F.pandas_udf(kind)
        def margins(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
                added = sent.value.additions(x)
                yield pd.Series(added.sum(axis=1) if last else list(added.cumsum(axis=1)))

        sound = [whole(F.col(c).cast("double"), self.features) for c in self.features]
        return df.withColumn(name, margins(*sound))

    def staged_margins(self, df: DataFrame, name: str = "margins") -> DataFrame:
        """``df`` with an array of the margins after each tree."""
        return self._scored(df, "array<double>", False, name)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self._scored(df, "double", True, "_margin")
        probability = 1 / (1 + F.exp(-2 * F.col("_margin")))
        return out.select(*df.columns, F.when(F.col("_margin") > 0, 1.0).otherwise(0.0).alias("prediction"), probability.alias("probability"))


@dataclass
class BoostedTrees:
    """Fitted trees as a table of nodes; the margin is the weighted sum of the leaves that a row reaches."""

    features: list[str]
    rows: list[tuple]  # tree, id (0: root), left, right, feature_index, threshold, prediction, gain, n_rows
    weights: list[float]

    def node_table(self, spark: SparkSession) -> DataFrame:
        kind = "tree int, id int, left int, right int, feature_index int, threshold double, prediction double, gain double, n_rows long"
        return spark.createDataFrame(self.rows, kind)

    @cached_property
    def packed(self) -> PackedTrees:
        table = sorted(self.rows, key=lambda r: (r[1] != 0, r[0], r[1]))  # roots first, by tree
        place = {r[:2]: k for k, r in enumerate(table)}
        left, right = (np.array([place.get((r[0], r[side]), -1) for r in table]) for side in (2, 3))
        feature, tree = (np.array([r[k] for r in table]) for k in (4, 0))
        value = np.array([r[6] * self.weights[r[0]] for r in table])
        nodes = Nodes(feature, np.array([r[5] for r in table], float), left, right, np.zeros((len(table), 2)), np.ones(len(table), np.int64), tree)
        return PackedTrees(self.features, nodes, value, len(self.weights))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.packed.predict(df)


def residuals(sign: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The negative slope of the log loss 2 log(1 + exp(-2 y F)), for classes -1 and 1."""
    return 2 * sign * (1 - np.tanh(sign * margin))


def best_splits(cells: np.ndarray, plan: Plan, tree: int, heap: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node (feature or -1, last place on the left, gain, count and sum on the left), from counts and residuals per place: [nodes, places, 2].

    The split of the largest fall of the variance over the drawn features, the first among equals.
    """
    d = len(plan.places)
    total = cells[:, : plan.places[0]].sum(axis=1)
    drawn = np.argsort(uniform_draws(plan.seed, np.int64(tree), heap[:, None], np.arange(d), 2), axis=1, kind="stable")[:, : plan.wanted]
    may = np.zeros((len(cells), d), bool)
    np.put_along_axis(may, drawn, True, axis=1)
    parts, feature, last, start = [], [], [], 0
    for f, size in enumerate(plan.places):
        parts.append(np.where(may[:, f, None, None], cells[:, start : start + size - 1].cumsum(axis=1), 0.0))
        feature += [f] * (size - 1)
        last += range(size - 1)
        start += size
    left = np.concatenate(parts, axis=1)
    none = np.full(len(cells), -1)
    if not feature:
        return none, none, np.zeros(len(cells)), np.zeros(len(cells)), np.zeros(len(cells))
    n, s = total[:, None, 0], total[:, None, 1]
    ln, ls = left[..., 0], left[..., 1]
    rn, rs = n - ln, s - ls
    sound = (ln > 0) & (rn > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(sound, (ls * ls / ln + rs * rs / rn - s * s / n) / n, -np.inf)
        least = np.maximum(plan.gamma, 1e-12 * (s[:, 0] / n[:, 0]) ** 2)  # below that it is the error of the sums
    most = gain.max(axis=1)
    at = (gain >= (most - np.abs(most) * 1e-9)[:, None]).argmax(axis=1)
    row = np.arange(len(cells))
    splits = np.isfinite(most) & (most > 0) & (most >= least)
    return np.where(splits, np.array(feature)[at], -1), np.array(last)[at], most, ln[row, at], ls[row, at]


#: A tree over places, root first: feature (-1: a leaf), last place on the left, children, and what a node as a leaf adds to the margin.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def routed(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The node that each row reaches, from places [features, rows]."""
    features, place, left, right, _ = tree
    rows = np.arange(x.shape[1])
    at = np.zeros(len(rows), np.int64)
    while True:
        feature = features[at]
        inner = feature >= 0
        if not inner.any():
            return at
        at = np.where(inner, np.where(x[np.maximum(feature, 0), rows] > place[at], right[at], left[at]), at)


@dataclass
class Share:
    """The rows of one task, by block: places [features, rows], class -1 or 1, copies, whether they are held back, and margins."""

    x: np.ndarray
    sign: np.ndarray
    n: np.ndarray
    held: np.ndarray
    blocks: np.ndarray
    starts: list[int]
    margin: np.ndarray

    @classmethod
    def of(cls, batches: Sequence[pa.RecordBatch]) -> Share:
        cols = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in range(batches[0].num_columns)]
        order = np.lexsort(cols[-2::-1])  # by block, then by content: draws don't depend on the order of arrival
        block, held, y, *x, n = (c[order] for c in cols)
        starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        return cls(np.array(x, np.uint16), np.where(y, 1.0, -1.0), n, held.astype(bool), block[starts[:-1]], starts, np.zeros(len(n)))

    def parts(self) -> tuple:
        """The arrays, as they are held in memory by Spark."""
        return self.x, self.sign, self.n, self.held, self.blocks, self.starts, self.margin

    def after(self, trees: Sequence[Tree]) -> np.ndarray:
        """The margins once these trees are added."""
        margin = self.margin.copy()
        for t in trees:
            margin += t[4][routed(t, self.x)]
        return margin

    def draw(self, subsample: float, seed: int, tree: int) -> np.ndarray:
        """How many copies of each row the tree sees."""
        n = np.where(self.held, 0, self.n)
        if subsample >= 1:
            return n.astype(float)
        out = np.empty(len(n))
        for block, a, b in zip(self.blocks, self.starts, self.starts[1:]):
            draws = np.random.Generator(np.random.Philox(key=[seed % (1 << 32) << 32 | tree, int(block)]))
            out[a:b] = draws.binomial(n[a:b], subsample)
        return out

    def cells(
        self, subsample: float, seed: int, sets: Sequence[tuple[int, ...]], places: Sequence[int], number: int, trees: Sequence[Tree], tree: Tree, opened: np.ndarray
    ) -> np.ndarray:
        """Counts and residuals per open node of the tree that grows, and joint place of each set of features: [nodes, joint places, 2]."""
        rank = np.full(len(tree[0]), -1)
        rank[opened] = np.arange(len(opened))
        weight, node = self.draw(subsample, seed, number), rank[routed(tree, self.x)]
        rows = np.flatnonzero((node >= 0) & (weight > 0))
        node, weight = node[rows], weight[rows]
        sign = self.sign[rows]
        target = sign if not number else residuals(sign, self.after(trees)[rows])
        parts = []
        for features in sets:
            place, size = node, 1
            for f in features:
                place, size = place * places[f] + self.x[f, rows], size * places[f]
            parts.append(np.stack([np.bincount(place, m, minlength=len(opened) * size).reshape(-1, size) for m in (weight, weight * target)], axis=2))
        return np.concatenate(parts, axis=1)

    def loss(self, trees: Sequence[Tree]) -> np.ndarray:
        """Summed log loss and number of the rows held back."""
        n = np.where(self.held, self.n, 0)
        return np.array([(n * 2 * np.logaddexp(0, -2 * self.sign * self.after(trees))).sum(), float(n.sum())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [b for b in batches if b.num_rows]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Share.of(found).parts())] if found else [], pa.binary())], names=["share"])


class Margins:
    """The rows in memory, with margins that follow the model."""

    def __init__(self, rows: RDD) -> None:
        self.shares = rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.code = rows.ctx.broadcast(Share)  # sent and loaded once, not with every pass
        self.stored: str | None = None
        self.pending: list[Tree] = []

    def sum(self, what: str, *args) -> np.ndarray:
        """What a method of the shares finds, added up over all tasks."""
        code = self.code
        return sum(self.shares.map(lambda parts: getattr(code.value(*parts), what)(*args)).collect())  # tasks times the cells of a pass

    def add(self, tree: Tree) -> None:
        self.pending = [*self.pending, tree]
        if len(self.pending) < KEPT:
            return
        trees, code = self.pending, self.code
        shares = self.shares.map(lambda parts: (*parts[:-1], code.value(*parts).after(trees))).persist(StorageLevel.MEMORY_AND_DISK)
        shares.checkpoint()  # cuts the lineage
        shares.count()
        self.close()
        self.shares, self.stored, self.pending = shares, shares.getCheckpointFile(), []

    def close(self) -> None:
        self.shares.unpersist()
        if self.stored:
            path = self.shares.ctx._jvm.org.apache.hadoop.fs.Path(self.stored)
            path.getFileSystem(self.shares.ctx._jsc.hadoopConfiguration()).delete(path, True)


def _compact(nodes: Sequence[list], rate: float) -> Tree:
    _, _, left, right, feature, place, value, *_ = (np.array(c) for c in zip(*nodes, strict=True))
    return feature, place, left, right, rate * value


class Joint:
    """Sets of ``levels`` features, and what the sums over their joint places say of the nodes below the open ones."""

    def __init__(self, places: Sequence[int], most: int) -> None:
        self.places, self.levels = places, 1
        for k in range(2, min(most, len(places)) + 1):
            if sum(math.prod(sizes) for sizes in itertools.combinations(places, k)) > CELLS:
                break
            self.levels = k
        self.sets = list(itertools.combinations(range(len(places)), self.levels))
        ends = np.cumsum([math.prod(places[f] for f in features) for features in self.sets]).tolist()
        self.spans = list(zip([0, *ends], ends))
        self.step = max(1, CELLS // ends[-1])  # nodes in one pass

    def cells(self, sums: np.ndarray, box: dict[int, tuple[int, int]]) -> np.ndarray:
        """Sums per place of each feature over the rows in the box, from those of an open node: [places, 2]."""
        out = []
        for f, size in enumerate(self.places):
            at = next(k for k, features in enumerate(self.sets) if f in features and all(g in features for g in box))
            features, (a, b) = self.sets[at], self.spans[at]
            cube = sums[a:b].reshape(*(self.places[g] for g in features), 2)
            cube = cube[tuple(slice(*box[g]) if g in box else slice(None) for g in features)]
            mine = cube.sum(axis=tuple(k for k, g in enumerate(features) if g != f))
            low = box.get(f, (0, size))[0]
            out.append(np.pad(mine, ((low, size - low - len(mine)), (0, 0))))
        return np.concatenate(out)


def grow_tree(state: Margins, plan: Plan, joint: Joint, number: int) -> list[list]:
    """The nodes of one tree: tree, id, left, right, feature, place, prediction, gain, rows."""
    nodes: list[list] = [[number, 0, -1, -1, -1, -1, 0.0, 0.0, 0.0]]
    heap, ids, depth = {0: 1}, [0], 0
    while True:
        tree, below = _compact(nodes, 1.0), []
        for a in range(0, len(ids), joint.step):  # bounded passes
            opened = ids[a : a + joint.step]
            sums = state.sum("cells", plan.subsample, plan.seed, joint.sets, plan.places, number, state.pending, tree, np.array(opened))
            if not depth:
                n, s = joint.cells(sums[0], {})[: plan.places[0]].sum(axis=0)
                if not n:
                    raise ValueError(f"tree {number} has no training rows")
                nodes[0][6], nodes[0][8] = float(s / n), float(n)
            at = [(i, k, {}) for k, i in enumerate(opened)]  # node, its open ancestor, and the box below that
            for _ in range(min(joint.levels, plan.depth - depth)):
                if at:
                    at = _split(nodes, heap, plan, number, at, np.array([joint.cells(sums[k], box) for _, k, box in at]))
            below += [i for i, _, _ in at]
        depth, ids = depth + joint.levels, below
        if not ids or depth >= plan.depth:
            return nodes


def _split(nodes: list[list], heap: dict[int, int], plan: Plan, number: int, at: list[tuple], cells: np.ndarray) -> list[tuple]:
    """Split the nodes where that lowers the variance; returns their children."""
    out = []
    totals = cells[:, : plan.places[0]].sum(axis=1)
    found = best_splits(cells, plan, number, np.array([heap[i] for i, _, _ in at]))
    for (i, k, box), (n, s), feature, last, gain, ln, ls in zip(at, totals, *found, strict=True):
        if feature < 0:
            continue
        feature, last = int(feature), int(last)
        low, high = box.get(feature, (0, plan.places[feature]))
        nodes[i][2:6], nodes[i][7] = [len(nodes), len(nodes) + 1, feature, last], float(gain)
        for side, (count, total, span) in enumerate(((ln, ls, (low, last + 1)), (n - ln, s - ls, (last + 1, high)))):
            heap[len(nodes)] = 2 * heap[i] + side
            out.append((len(nodes), k, {**box, feature: span}))
            nodes.append([number, len(nodes), -1, -1, -1, -1, float(total / count), 0.0, float(count)])
    return out


def _grown(state: Margins, plan: Plan) -> list[list]:
    """The nodes of all trees; with rows held back, those up to the least loss, going on as long as it falls by the tolerance."""
    nodes, best, kept = [], math.inf, plan.trees
    joint = Joint(plan.places, plan.depth)
    for number in range(plan.trees):
        own = grow_tree(state, plan, joint, number)
        nodes += own
        state.add(_compact(own, plan.rate if number else 1.0))
        if plan.tolerance is None:
            continue
        loss, rows = state.sum("loss", state.pending)
        if not rows:
            raise ValueError("no validation rows")
        loss /= rows
        if number and best - loss < plan.tolerance * max(loss, 0.01):
            break
        if loss < best:
            best, kept = loss, number + 1
    return [n for n in nodes if n[0] < kept]


def boost(df: DataFrame, features: Sequence[str], label: str, plan_of: Callable[[tuple[int, ...]], Plan], held: str | None = None) -> BoostedTrees:
    """Fit to the rows of ``df``; those where ``held`` is true only say when to stop."""
    features = list(features)
    spark = df.sparkSession
    keep_checkpoints(spark)
    if held:
        df = df.where(F.col(held).isNotNull())
    cuts = cut_points(df.where(~F.col(held)) if held else df, features, BINS)
    plan = plan_of(tuple(len(c) + 1 for c in cuts))
    placed = placed_rows(df, features, label, cuts, held)
    rows = placed.count()
    if not rows:
        raise ValueError("no training rows")
    tasks = min(BLOCKS, max(math.ceil(rows / MANY), min(spark.sparkContext.defaultParallelism, math.ceil(rows / FEW))))
    x = [f"x{i}" for i in range(len(features))]
    block = F.pmod(F.xxhash64("_f", "_y", *x), F.lit(BLOCKS)).cast("int")
    slim = placed.select(block.alias("_block"), F.col("_f") > 0, F.col("_y") > 0, *x, F.col("_n").cast("long").alias("_n"))
    dealt = slim.repartitionById(tasks, F.col("_block") % tasks).mapInArrow(_packed, "share binary")
    state = Margins(dealt.rdd.map(lambda r: pickle.loads(r["share"])))
    try:
        found = _grown(state, plan)
    finally:
        state.close()
        discard(placed)
    rows = [(*r[:5], float(cuts[r[4]][r[5]]) if r[4] >= 0 else 0.0, r[6], r[7], int(r[8])) for r in found]
    return BoostedTrees(features, rows, [plan.rate if k else 1.0 for k in range(1 + rows[-1][0])])
