"""Centroid clustering of integer vectors, with centroids filtered by n-simplex projection.

A vector of ``dims`` components, none null or non-finite, becomes the integers floor(scale * x). The first centroids are the
``k`` kept vectors with the smallest SHA-256 of ``1:<id>``. Each round assigns every vector to its nearest centroid (squared
Euclidean distance, ties to the smaller number) and moves each centroid that has vectors to their componentwise floor(sum / count).

The projection: a few pivots span a simplex. The distances of a vector to the pivots are computed once, and turned into
the coordinates of an apex over that simplex, which are stored beside the vector. Between two apexes the plain distance, and the
distance with the last coordinate of one reversed, bound the true distance from below and above; a centroid whose lower bound lies
above the least upper bound can't be nearest. Those left are compared by whole numbers. Bounds are widened by the
rounding that is possible, so the filter never decides.

Only ``k`` centroids, the pivots and ``k * dims`` sums reach the driver. Rows are not shuffled: tasks send sums per centroid.

Cases: other vectors (null, other lengths, null or non-finite components) are left out. Components beyond 2^27 after scaling count as 2^27,
so that squared distances fit 64 bits; a sum of distances that doesn't is null. A null id counts as empty text in the hash. Equal ids are ordered by
their components, repeated rows are vectors of their own, and fewer vectors than ``k`` give as many centroids as there are vectors. An
empty table gives an empty result. Other columns are left out; result columns get an underscore where the id column has their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.columns import spare_names
from surveyloom.schema import require_columns
from surveyloom.session import materialize

#: Largest component, so that a squared distance of up to 2^6 components fits a signed 64-bit integer.
BOUND = 1 << 27
MAX_DIMS = 64
#: A pivot joins the simplex if it stands above it by this share of its distance from the first one.
LEAST_ALTITUDE = 0.05


def whole_parts(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * vectors.astype(np.float64)), -BOUND, BOUND).astype(np.int64)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    off = vectors - point
    return np.einsum("ij,ij->i", off, off)


@dataclass(frozen=True)
class Simplex:
    """Pivots in the coordinates of their own simplex: row i of ``base`` is the apex of pivot i + 1 over the pivots before it."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def over(cls, candidates: np.ndarray) -> Simplex:
        """The candidates in their order, without those that lie in (or nearly in) the span of the ones before."""
        out = cls(candidates[:1], np.zeros((0, 0)))
        for pivot in candidates[1:]:
            apex = out.project(pivot[None])[0]
            reach = float(np.linalg.norm(apex))
            if reach and apex[-1] >= LEAST_ALTITUDE * reach:
                m = len(out.base)
                base = np.zeros((m + 1, m + 1))
                base[:m, :m], base[m] = out.base, apex
                out = cls(np.concatenate([out.pivots, pivot[None]]), base)
        return out

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """The apex of every vector, from its distances to the pivots alone."""
        near = squared(vectors, self.pivots[0]).astype(float)
        out = np.zeros((len(vectors), len(self.pivots)))
        for i, row in enumerate(self.base):
            gap = (near + row @ row - squared(vectors, self.pivots[i + 1])) / 2
            out[:, i] = (gap - out[:, :i] @ row[:i]) / row[i]
        out[:, -1] = np.sqrt(np.maximum(near - np.einsum("ij,ij->i", out, out), 0.0))
        return out

    def doubt(self, apexes: np.ndarray) -> np.ndarray:
        """More than rounding can move an apex."""
        least = np.linalg.svd(self.base, compute_uv=False)[-1] if len(self.base) else 1.0
        widest = np.linalg.norm(self.base) if len(self.base) else 0.0
        reach = np.linalg.norm(apexes, axis=1) + widest
        side = 1e-11 * reach + 1e-13 * reach * reach / least
        return side + np.sqrt(2 * reach * side)


def candidates(simplex: Simplex, apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be nearest to each vector (rows), by the bounds of the simplex."""
    tops = simplex.project(centres)
    slack = simplex.doubt(apexes)[:, None] + simplex.doubt(tops)[None]
    lower, upper = (np.empty((len(apexes), len(centres))) for _ in range(2))
    for c, top in enumerate(tops):
        off = apexes[:, :-1] - top[:-1]
        flat = np.einsum("ij,ij->i", off, off)
        lower[:, c] = np.sqrt(flat + (apexes[:, -1] - top[-1]) ** 2)
        upper[:, c] = np.sqrt(flat + (apexes[:, -1] + top[-1]) ** 2)
    return lower - slack <= (upper + slack).min(axis=1)[:, None]


def nearest(simplex: Simplex, vectors: np.ndarray, apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, by exact comparison of the candidates."""
    maybe = candidates(simplex, apexes, centres)
    best, at = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for c, centre in enumerate(centres):
        rows = np.flatnonzero(maybe[:, c])
        off = squared(vectors[rows], centre)
        closer = off < best[rows]
        best[rows[closer]], at[rows[closer]] = off[closer], c
    return at, best


def _matrix(lists: pa.Array, dtype) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(dtype, copy=False)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def _project(simplex: Simplex, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = whole_parts(_matrix(batch.column("vector"), np.float64), scale)
                cols = [batch.column("id"), _lists(parts, pa.int32()), _lists(simplex.project(parts), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "parts", "apex"])

    return run


def _sums(sent):
    """Per task: vectors and component sums of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simplex, centres = sent.value
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                parts = _matrix(batch.column("parts"), np.int64)
                at, _ = nearest(simplex, parts, _matrix(batch.column("apex"), float), centres)
                n += np.bincount(at, minlength=len(centres))
                np.add.at(total, at, parts)
        for c in np.flatnonzero(n):
            size = total.shape[1]
            cols = [pa.array(np.full(size, c, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(total[c]), pa.array(np.full(size, n[c]))]
            yield pa.RecordBatch.from_arrays(cols, names=["cluster", "place", "total", "n"])

    return run


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simplex, centres = sent.value
        for batch in batches:
            if batch.num_rows:
                parts = _matrix(batch.column("parts"), np.int64)
                at, off = nearest(simplex, parts, _matrix(batch.column("apex"), float), centres)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at), pa.array(off)], names=["id", "cluster", "distance"])

    return run


def _moved(stored: DataFrame, simplex: Simplex, centres: np.ndarray) -> np.ndarray:
    """One round: centroids at the floors of their vectors' means; those without vectors stay."""
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast((simplex, centres))
    wide = F.sum(F.col("total").cast("decimal(20,0)"))
    sums = stored.mapInArrow(_sums(sent), "cluster int, place int, total long, n long")
    out = centres.copy()
    for r in sums.groupBy("cluster", "place").agg(wide.alias("total"), F.sum("n").alias("n")).collect():  # k * dims rows
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    sent.unpersist()
    return out


def _finite(vector: Column, dims: int) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & sound, F.lit(False))


def centroid_text(centre: Sequence[int]) -> str:
    return ",".join(str(int(x)) for x in centre)


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: float = 64.0,
    pivots: int = 16,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    ``pivots`` is how many of the first centroids, and of the vectors that follow them in hash order, span the simplex.
    """
    require_columns(df, id_col, vector_col)
    if not 0 < dims <= MAX_DIMS:
        raise ValueError(f"dims must be 1 to {MAX_DIMS}")
    spark = df.sparkSession
    named = spare_names(df.select(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(_finite(F.col("vector"), dims))
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = rows.orderBy(mark, "vector").limit(max(k, pivots)).select("vector").collect()
    heads = whole_parts(np.array([r["vector"] for r in drawn], float).reshape(-1, dims), scale)
    centres, simplex = heads[:k], Simplex.over(heads[:pivots])
    id_type = rows.schema["id"].dataType.simpleString()
    cores = spark.sparkContext.defaultParallelism
    dealt = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows  # few files are dealt over all cores, once
    stored = materialize(dealt.mapInArrow(_project(simplex, scale), f"id {id_type}, parts array<int>, apex array<double>"), "centroid-apexes")
    if not len(centres):
        none = [F.lit(None).cast(t) for t in ("int", "long", "long", "long", "string")]
        return stored.select(F.col("id").alias(id_col), *[c.alias(n) for c, n in zip(none, named, strict=True)])
    for _ in range(rounds):
        centres = _moved(stored, simplex, centres)
    sent = spark.sparkContext.broadcast((simplex, centres))
    assigned = materialize(stored.mapInArrow(_assign(sent), f"id {id_type}, cluster int, distance long"), "centroid-clusters")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}
    table = [(c, _long(x), hashlib.sha256(centroid_text(centres[c]).encode()).hexdigest()) for c, x in sorted(inertia.items())]
    facts = spark.createDataFrame(table, "number int, own long, sha string")  # at most k rows
    joined = assigned.join(F.broadcast(facts), F.col("cluster") == F.col("number"))
    result = [F.col("cluster"), F.col("distance"), F.col("own"), F.lit(_long(sum(inertia.values()))).cast("long"), F.col("sha")]
    return joined.select(F.col("id").alias(id_col), *[c.alias(n) for c, n in zip(result, named, strict=True)])


def _long(value: Decimal) -> int | None:
    return int(value) if value < 1 << 63 else None
