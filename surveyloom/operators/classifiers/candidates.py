"""Many candidates of a family on all folds at once.

A training fold is the whole table less the fold. For families whose models follow from counts, means and products of the
features per class, one aggregate per fold and class therefore holds all that any candidate on any fold needs; it has the
size of the features squared, whatever the table's. The candidates of all folds are then scored in one more
pass: each row meets the models of its own fold as one matrix product, and tasks send confusion counts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import binary_label, whole

#: Margins that a task holds at once, as rows times candidates.
MARGINS = 2_000_000
COUNTS = "fold int, trial int, tp long, fp long, fn long, tn long"


@dataclass(frozen=True)
class ClassMoments:
    """Rows, means and sums of centred products per class; ``rows`` [2], ``mean`` [2, d], ``products`` [2, d, d]."""

    rows: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    def merged(self) -> tuple[float, np.ndarray, np.ndarray]:
        """The same over both classes."""
        return merge(list(zip(self.rows, self.mean, self.products, strict=True)))


def merge(parts: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of the union of disjoint sets of rows, without the cancellation of raw sums."""
    n, mean, products = 0.0, np.zeros_like(parts[0][1]), np.zeros_like(parts[0][2])
    for m, other, own in parts:
        if m:
            off = other - mean
            products = products + own + np.outer(off, off) * (n * m / (n + m))
            mean = mean + off * (m / (n + m))
            n += m
    return n, mean, products


@dataclass(frozen=True)
class Margin:
    """A margin square . z^2 + linear . z + constant of the features z = x - centre."""

    centre: np.ndarray
    square: np.ndarray
    linear: np.ndarray
    constant: float


def fold_moments(folded: DataFrame, features: Sequence[str], label: str, fold: str = "fold") -> dict[int, ClassMoments]:
    """Moments of each fold from one aggregate; brings back a row per fold and class."""
    d = len(features)
    x = folded.select(
        F.col(fold).alias("_f"), binary_label(label).alias("_y"), *[whole(F.col(c).cast("double"), features).alias(f"x{i}") for i, c in enumerate(features)]
    )
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    aggs = [F.avg(f"x{i}").alias(f"m{i}") for i in range(d)] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]
    out: dict[int, ClassMoments] = {}
    for r in x.groupBy("_f", "_y").agg(F.count("*").alias("n"), *aggs).collect():
        at = out.setdefault(r["_f"], ClassMoments(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))))
        k = r["_y"]
        at.rows[k] = r["n"]
        at.mean[k] = [r[f"m{i}"] for i in range(d)]
        for i, j in pairs:
            at.products[k, i, j] = at.products[k, j, i] = r[f"c{i}_{j}"] * r["n"]
    return out


def training_moments(by_fold: Mapping[int, ClassMoments], held: int | None) -> ClassMoments:
    """Moments of all rows outside the held fold (None: of all rows)."""
    used = [m for f, m in sorted(by_fold.items()) if f != held]
    if not used:
        raise ValueError("no training rows")
    both = [merge([(m.rows[k], m.mean[k], m.products[k]) for m in used]) for k in (0, 1)]
    if not all(n for n, _, _ in both):
        raise ValueError("both classes are needed")
    return ClassMoments(np.array([b[0] for b in both]), np.array([b[1] for b in both]), np.array([b[2] for b in both]))


def bayes_margin(moments: ClassMoments, *, var_smoothing: float = 1e-9) -> Margin:
    """Gaussian naive Bayes: the difference of the class log likelihoods."""
    n, centre, products = moments.merged()
    extra = var_smoothing * float((products.diagonal() / n).max())
    var = np.array([moments.products[k].diagonal() / moments.rows[k] + extra for k in (0, 1)])
    off = moments.mean - centre
    square = 0.5 / var[0] - 0.5 / var[1]
    linear = off[1] / var[1] - off[0] / var[0]
    halves = [np.log(moments.rows[k] / n) - 0.5 * np.log(2 * np.pi * var[k]).sum() - 0.5 * (off[k] ** 2 / var[k]).sum() for k in (0, 1)]
    return Margin(centre, square, linear, float(halves[1] - halves[0]))


def discriminant_margin(moments: ClassMoments, *, solver: str = "lsqr", shrinkage: float | None = None) -> Margin:
    """Linear discriminant analysis on standard scores of the training rows."""
    if solver == "svd" and shrinkage:
        raise ValueError("the svd solver takes no shrinkage")
    n, centre, products = moments.merged()
    d = len(centre)
    spread = np.sqrt(products.diagonal() / n)
    scale = np.divide(1.0, spread, out=np.zeros(d), where=spread > 0)  # a column without spread is zero everywhere
    cov = moments.products.sum(axis=0) / n * np.outer(scale, scale)
    lam = float(shrinkage or 0.0)
    cov = (1 - lam) * cov + lam * np.trace(cov) / d * np.eye(d)
    low, high = (moments.mean - centre) * scale
    w = np.linalg.pinv(cov) @ (high - low)
    constant = -0.5 * float((low + high) @ w) + float(np.log(moments.rows[1] / moments.rows[0]))
    return Margin(centre, np.zeros(d), w * scale, constant)


#: Per (trial, fold) the model, or the message of the fit that failed.
Models = dict[tuple[int, int], "Margin | str"]
#: (fold, trial, tp, fp, fn, tn) of all that could be fitted, and the messages of the others.
Outcome = tuple[DataFrame, dict[tuple[int, int], str]]


def from_moments(margin: Callable[..., Margin]) -> Callable[..., Outcome]:
    """All candidates on all folds of a family that needs only the moments."""

    def fit(folded: DataFrame, features: Sequence[str], label: str, candidates: Sequence[Mapping], folds: int) -> Outcome:
        by_fold = fold_moments(folded, features, label)
        models: Models = {}
        for f in range(folds):
            for t, params in enumerate(candidates):
                try:
                    models[t, f] = margin(training_moments(by_fold, f), **params)
                except (ValueError, TypeError, np.linalg.LinAlgError) as e:  # recorded as a row; the other candidates go on
                    models[t, f] = f"{type(e).__name__}: {e}"
        return outcome(folded, features, label, models)

    return fit


def outcome(folded: DataFrame, features: Sequence[str], label: str, models: Models) -> Outcome:
    return confusion_of(folded, features, label, models), {k: m for k, m in models.items() if isinstance(m, str)}


def _confusion(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = sent.value  # fold -> (trials, centre, coefficients)
        cells = {f: np.zeros((len(trials), 4), np.int64) for f, (trials, _, _) in sets.items()}
        for batch in batches:
            folds, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            for f, (trials, centre, coefs) in sets.items():
                rows = np.flatnonzero(folds == f)
                step = max(1, MARGINS // len(trials))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    z = x[part] - centre
                    positive = np.column_stack([z * z, z, np.ones(len(part))]) @ coefs > 0
                    actual = y[part] == 1
                    tp, fp = positive[actual].sum(axis=0), positive[~actual].sum(axis=0)
                    cells[f] += np.column_stack([tp, fp, actual.sum() - tp, (~actual).sum() - fp])
        for f, (trials, _, _) in sets.items():
            cols = [pa.array(np.full(len(trials), f, np.int32)), pa.array(np.array(trials, np.int32)), *(pa.array(c) for c in cells[f].T.copy())]
            yield pa.RecordBatch.from_arrays(cols, names=["fold", "trial", "tp", "fp", "fn", "tn"])

    return run


def confusion_of(folded: DataFrame, features: Sequence[str], label: str, models: Models, fold: str = "fold") -> DataFrame:
    """(fold, trial, tp, fp, fn, tn) of every model on the rows of its fold, in one pass."""
    sets: dict = {}
    for (t, f), m in sorted(models.items()):
        if isinstance(m, Margin):
            sets.setdefault(f, ([], m.centre, []))
            sets[f][0].append(t)
            shift = sets[f][1] - m.centre  # all models of a fold in the coordinates of the first
            constant = m.constant + float(m.linear @ shift + m.square @ (shift * shift))
            sets[f][2].append(np.concatenate([m.square, m.linear + 2 * m.square * shift, [constant]]))
    packed = {f: (trials, centre, np.array(coefs).T) for f, (trials, centre, coefs) in sets.items()}
    if not packed:
        return folded.sparkSession.createDataFrame([], COUNTS)
    sent = folded.sparkSession.sparkContext.broadcast(packed)  # candidates x folds x features
    x = folded.select(F.col(fold).cast("int").alias("fold"), binary_label(label).alias("_y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    cells = ("tp", "fp", "fn", "tn")
    return x.mapInArrow(_confusion(sent), COUNTS).groupBy("fold", "trial").agg(*[F.sum(c).alias(c) for c in cells])
