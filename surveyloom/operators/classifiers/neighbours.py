"""Exact k nearest neighbours as a block join.

Neither side is broadcast or gathered. Training vectors are assigned to the nearest of some pivots, whose number
grows with the root of the table, and the cells are cut into rings by distance to the pivot and then into blocks of bounded size. The
triangle inequality bounds each query's k-th distance from the ring counts alone, so a query travels
only to rings that can hold a neighbour. Every (block, query chunk) pair is one task-sized group of
matrix work that returns at most k candidates per query; a last top-k per query joins them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.hashing import key_hash
from surveyloom.operators.classifiers.base import Scaler, scaled
from surveyloom.session import materialize

PIVOTS = 16  # at least, where there are as many blocks
RINGS = 8
BLOCK_ROWS = 20_000
CHUNK_ROWS = 4_000
_STEP = 256


def feature_vector(features: Sequence[str] | str) -> Column:
    """One array<double> column from several numeric columns, or from one array column."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Row by row distances of two equally long matrices."""
    diff = a - b
    return np.abs(diff).sum(axis=1) if p == 1 else np.sqrt((diff * diff).sum(axis=1))


def _all_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    if p == 2:
        sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(sq, 0))
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += np.abs(a[:, j][:, None] - b[:, j][None, :])
    return out


def block_top_k(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, p: int) -> tuple[np.ndarray, ...]:
    """(query position, row position, distance) of the k nearest rows of each query, ties by id.

    A fast matrix form picks the rows within rounding of the k-th distance; those are measured again
    directly, so the result does not depend on how the rows were blocked.
    """
    who, what, dist = [], [], []
    scale = max(float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)), 1e-300)
    slack = 1e-6 * scale * q.shape[1]
    for start in range(0, len(q), _STEP):
        part = q[start : start + _STEP]
        rough = _all_distances(part, x, p)
        if len(x) > k:
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero(rough <= (kth + slack)[:, None])
        else:
            i, j = (m.ravel() for m in np.indices(rough.shape))
        d = distances(part[i], x[j], p)
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        who.append(i[keep] + start)
        what.append(j[keep])
        dist.append(d[keep])
    return np.concatenate(who), np.concatenate(what), np.concatenate(dist)


def _lookup(values: Sequence, index: Column) -> Column:
    """The entry of a short constant list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(float)


def _with_cells(df: DataFrame, pivots: np.ndarray, p: int) -> DataFrame:
    @F.pandas_udf("struct<cell int, pivot_dist double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            x = _matrix(s)
            cell = _all_distances(x, pivots, p).argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype("int32"), "pivot_dist": distances(x, pivots[cell], p)})

    return df.withColumn("_at", place("x")).select(*df.columns, "_at.cell", "_at.pivot_dist")


def nearest(
    train: DataFrame,
    query: DataFrame,
    k: int,
    p: int = 2,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The k nearest training rows of every distinct query vector: (x, id, label, dist).

    ``train`` has (id, x, label), ``query`` has (x) with distinct vectors. Equal distances go by id.
    """
    # A vector shared by many rows can be a neighbour k times at most, so k rows of it are enough;
    # the row limit is applied in each task before the shuffle.
    same = Window.partitionBy("x").orderBy("id")
    rows = train.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    rows, query = materialize(rows, "neighbours"), materialize(query.select("x"), "queries", spread=True)
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    trips, sent = _routed(rows, query, n, k, p, block_rows, chunk_rows)

    def match(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = ["x", "id", "label", "dist"]
        if q.empty or t.empty:
            return pd.DataFrame({c: [] for c in cols})
        who, what, dist = block_top_k(_matrix(q["x"]), _matrix(t["x"]), t["id"].to_numpy(), k, p)
        return pd.DataFrame(
            {
                "x": q["x"].to_numpy()[who],
                "id": t["id"].to_numpy()[what],
                "label": t["label"].to_numpy()[what],
                "dist": dist,
            }
        )

    partial = (
        trips.groupBy("chunk", "block")
        .cogroup(sent.groupBy("to_chunk", "to_block"))
        .applyInPandas(match, "x array<double>, id long, label int, dist double")
    )
    best = Window.partitionBy("x").orderBy("dist", "id")
    return partial.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def _routed(
    rows: DataFrame, query: DataFrame, n: int, k: int, p: int, block_rows: int, chunk_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Queries with the blocks they must visit, and training rows with the query chunks that visit them."""
    pivots = min(max(PIVOTS, math.isqrt(n) // 64), -(-n // block_rows))
    rings = min(RINGS, -(-n // (pivots * block_rows)) + 1)
    seeds = rows.select("id", "x").orderBy(key_hash("id", 7)).limit(pivots).collect()
    centres = np.array([r["x"] for r in seeds], dtype=float)

    placed = _with_cells(rows, centres, p)
    reach = {r["cell"]: r["m"] for r in placed.groupBy("cell").agg(F.max("pivot_dist").alias("m")).collect()}
    step = _lookup([reach.get(c, 0.0) / rings for c in range(len(centres))], F.col("cell"))
    ring = F.coalesce(F.least(F.lit(rings - 1), F.try_divide("pivot_dist", step).cast("int")), F.lit(0))
    ringed = placed.withColumn("slot", F.col("cell") * rings + ring)
    found = (
        ringed.groupBy("cell", "slot")
        .agg(F.count("*").alias("n"), F.min("pivot_dist").alias("lo"), F.max("pivot_dist").alias("hi"))
        .orderBy("slot")
        .collect()
    )  # at most pivots * rings rows
    ring_cell = np.array([r["cell"] for r in found])
    ring_n = np.array([r["n"] for r in found])
    ring_lo = np.array([r["lo"] for r in found])
    ring_hi = np.array([r["hi"] for r in found])
    ring_parts = -(-ring_n // block_rows)
    ring_start = np.concatenate([[0], np.cumsum(ring_parts)[:-1]])

    starts, parts = {}, {}
    for r, start, n in zip(found, ring_start, ring_parts):
        starts[r["slot"]], parts[r["slot"]] = int(start), int(n)
    slots = range(len(centres) * rings)
    block = _lookup([starts.get(i, 0) for i in slots], F.col("slot")) + F.pmod(
        F.xxhash64("id"), _lookup([parts.get(i, 1) for i in slots], F.col("slot"))
    )
    blocks = ringed.select("id", "x", "label", block.cast("long").alias("block"))

    @F.pandas_udf("array<long>")
    def visited(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = _matrix(s)
            to_pivot = _all_distances(x, centres, p)[:, ring_cell]
            far = to_pivot + ring_hi
            order = np.argsort(far, axis=1)
            enough = (np.cumsum(ring_n[order], axis=1) >= k).argmax(axis=1)
            short = ring_n.sum() < k
            line = np.arange(len(x))
            bound = np.full(len(x), np.inf) if short else far[line, order[line, enough]]
            least = np.maximum(np.maximum(to_pivot - ring_hi, ring_lo - to_pivot), 0.0)
            size = np.abs(x).max(axis=1) + np.abs(centres).max()
            may = least <= bound[:, None] + (1e-6 * size * x.shape[1])[:, None]
            out = []
            for row in may:
                hit = np.nonzero(row)[0]
                out.append(np.concatenate([np.arange(ring_start[h], ring_start[h] + ring_parts[h]) for h in hit]))
            yield pd.Series(out)

    # Queries of one cell share chunks, so that a block is copied to few of them.
    asked = _with_cells(query, centres, p).drop("pivot_dist")
    sizes = asked.groupBy("cell").agg(F.count("*").alias("n")).collect()
    asked_n = {r["cell"]: r["n"] for r in sizes}
    parts_of = _lookup([-(-asked_n.get(c, 1) // chunk_rows) for c in range(len(centres))], F.col("cell"))
    chunk = F.concat_ws("-", F.col("cell").cast("string"), F.pmod(F.xxhash64("x"), parts_of).cast("string"))
    trips = asked.select("x", chunk.alias("chunk"), F.explode(visited("x")).alias("block"))
    routes = trips.select("chunk", "block").distinct()
    sent = blocks.join(routes, "block").select(
        "id", "x", "label", F.col("chunk").alias("to_chunk"), F.col("block").alias("to_block")
    )

    return trips, sent


def vote(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """(x, prediction, probability): the label with most votes, the smaller one on a tie.

    With 'distance' a vote counts 1 / distance, and neighbours at distance 0 leave no other a say.
    """
    near = neighbours
    if weights == "distance":
        exact = F.max(F.col("dist") == 0).over(Window.partitionBy("x"))
        share = F.when(F.col("_exact"), (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), "dist"))
        near = near.withColumn("_exact", exact).withColumn("_v", share)
    elif weights == "uniform":
        near = near.withColumn("_v", F.lit(1.0))
    else:
        raise ValueError(f"unknown weights {weights}")
    counted = near.groupBy("x", "label").agg(F.sum("_v").alias("v"))
    return counted.groupBy("x").agg(
        F.max_by("label", F.struct(F.col("v"), -F.col("label"))).cast("double").alias("prediction"),
        F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("v")).otherwise(0.0)), F.sum("v")).alias("probability"),
    )


def knn_predict(
    train: DataFrame,
    query: DataFrame,
    features: Sequence[str] | str,
    key: str,
    label: str,
    k: int = 5,
    weights: str = "uniform",
    p: int = 2,
    **sizes,
) -> DataFrame:
    """The query rows with ``prediction`` and ``probability`` (of class 1). Works for any number of classes."""
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    t = train.select(
        F.col(key).cast("long").alias("id"), feature_vector(features).alias("x"), F.col(label).cast("int").alias("label")
    )
    q = query.withColumn("_x", feature_vector(features))
    # Each distinct vector is looked up once, however many rows hold it.
    votes = vote(nearest(t, q.select(F.col("_x").alias("x")).distinct(), k, p, **sizes), weights)
    return q.join(votes.withColumnRenamed("x", "_x"), "_x", "left").select(*query.columns, "prediction", "probability")


class NeighbourModel:
    """Neighbours on scaled features behind the common ``predict``; the training frame is the model."""

    def __init__(self, train: DataFrame, features: Sequence[str], key: str, label: str, scaler: Scaler, **options):
        self.features, self.key, self.label = list(features), key, label
        self.scaler, self.options = scaler, options
        self.train = train

    def predict(self, df: DataFrame) -> DataFrame:
        names = [scaled(c) for c in self.features]
        out = knn_predict(
            self.scaler.apply(self.train), self.scaler.apply(df), names, self.key, self.label, **self.options
        )
        return out.select(*df.columns, "prediction", "probability")


def fit_neighbours(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    key: str,
    n_neighbors: int = 5,
    weights: str = "uniform",
    p: int = 2,
) -> NeighbourModel:
    return NeighbourModel(
        df, features, key, label, Scaler.fit(df, features), k=int(n_neighbors), weights=weights, p=int(p)
    )
