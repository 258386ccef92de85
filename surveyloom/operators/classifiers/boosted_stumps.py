"""Adaptive boosting of decision stumps.

A stump tests one feature, so the sum of all stumps so far is a sum of one table per feature over the places of its values: the state of a
fit has the size of features times places, whatever the number of rows or rounds. Rows are placed once (equal rows become one counted
row); a round is one pass in which tasks look a row's weight up in these tables and add it to a histogram, and the best stump is read
off the running sums of the histogram. Any number of fits - candidates of a search, and folds left out - shares the passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import ExpressionModel, binary_label, whole
from surveyloom.operators.classifiers.candidates import COUNTS, Outcome
from surveyloom.operators.selection import grouped_quantiles
from surveyloom.session import deal, discard, materialize

#: A feature with more distinct values than this is cut at so many quantiles instead of between all its values.
PLACES = 1024
PERFECT = 1e-12


@dataclass
class Fit:
    """One boosted model while it grows: the score that each place of each feature adds."""

    rounds: int
    rate: float
    held: int | None
    tables: np.ndarray
    alphas: list[float] = field(default_factory=list)
    stumps: list[tuple[int, int, float, float]] = field(default_factory=list)  # feature, last place on the left, both signs
    done: bool = False

    def add(self, positive: np.ndarray, negative: np.ndarray, places: Sequence[int]) -> None:
        """One round, from the weights of each class per feature and place."""
        found = best_stump(positive, negative, places)
        p, n = positive[0].sum(), negative[0].sum()
        feature, last, left, right = found if found else (0, places[0] - 1, 1.0 if p > n else -1.0, 0.0)
        side = np.arange(positive.shape[1]) <= last
        wrong = np.where(np.where(side, left, right) > 0, negative[feature], positive[feature]).sum()
        error = wrong / (p + n) if p + n > 0 else 1.0
        if error >= 0.5:
            self.done = True
            return
        alpha = self.rate * math.log((1 - error) / max(error, PERFECT))
        self.alphas.append(alpha)
        self.stumps.append((feature, last, left, right))
        self.tables[feature] += alpha * np.where(side, left, right)
        self.done = error <= PERFECT or len(self.alphas) >= self.rounds


def best_stump(positive: np.ndarray, negative: np.ndarray, places: Sequence[int]) -> tuple[int, int, float, float] | None:
    """(feature, last place on the left, sign on the left, sign on the right) of the least Gini impurity; the first one among equals.

    None if no feature has two places with weight.
    """
    p, n = positive[0].sum(), negative[0].sum()
    best, least = None, math.inf
    for f, size in enumerate(places):
        lp, ln = np.cumsum(positive[f, : size - 1]), np.cumsum(negative[f, : size - 1])
        rp, rn = p - lp, n - ln
        left, right = lp + ln, rp + rn
        sound = (left > 0) & (right > PERFECT * (p + n))
        if not sound.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = np.where(sound, lp * ln / left + rp * rn / right, np.inf)
        k = int(np.flatnonzero(impurity <= impurity.min() * (1 + 1e-9))[0])
        if impurity[k] < least * (1 - 1e-9):
            least = impurity[k]
            best = f, k, 1.0 if lp[k] > ln[k] else -1.0, 1.0 if rp[k] > rn[k] else -1.0
    return best


def cut_points(df: DataFrame, features: Sequence[str], most: int = PLACES) -> list[np.ndarray]:
    """Per feature the thresholds between its places: halfway between neighbouring values, or at quantiles of a feature of many values."""
    wide = df.select(*[whole(F.col(c).cast("double"), features).alias(c) for c in features])
    long = materialize(wide.unpivot([], list(features), "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n")), "value-counts")
    sizes = {r["feature"]: r["n"] for r in long.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    short = [f for f, n in sizes.items() if n <= most]
    values: dict = {}
    for r in long.where(F.col("feature").isin(short)).collect():  # at most ``most`` values per feature
        values.setdefault(r["feature"], []).append(r["value"])
    many = [f for f in sizes if f not in short]
    if many:
        cuts = grouped_quantiles(wide.select(*many).unpivot([], many, "feature", "value"), [k / most for k in range(1, most)])
        for r in cuts.collect():
            values.setdefault(r["feature"], []).append(r["quantile"])
    discard(long)
    out = []
    for c in features:
        x = np.unique(np.array(values.get(c, []), float))
        out.append(x if c in many else (x[:-1] + x[1:]) / 2)
    return out


def _places(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.searchsorted(cut, c.to_numpy(zero_copy_only=False), side="left") for cut, c in zip(cuts, batch.columns[2:], strict=True)]
            cols = [*batch.columns[:2], *(pa.array(x.astype(np.int32)) for x in found)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def placed_rows(df: DataFrame, features: Sequence[str], label: str, cuts: list[np.ndarray], fold: str | None = None) -> DataFrame:
    """(fold, y, place of each feature, n), stored over all cores."""
    x = [whole(F.col(c).cast("double"), features).alias(f"x{i}") for i, c in enumerate(features)]
    mark = F.lit(-1) if fold is None else F.col(fold)
    slim = df.select(mark.cast("int").alias("_f"), binary_label(label).alias("_y"), *x)
    schema = ", ".join(["_f int", "_y int", *(f"x{i} int" for i in range(len(features)))])
    placed = slim.mapInArrow(_places(cuts), schema)
    return deal(materialize(placed.groupBy(*placed.columns).agg(F.count("*").cast("double").alias("_n")), "placed-rows"), "placed-rows")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    folds, y, *places, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return folds, y, np.column_stack(places), n


def _score(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return table[np.arange(places.shape[1]), places].sum(axis=1)


def _histograms(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = sent.value  # [fits, features, places], [fits]
        fits, d, size = tables.shape
        out = np.zeros((fits, 2, d, size))
        for batch in batches:
            folds, y, places, n = _columns(batch)
            sign = np.where(y > 0, 1.0, -1.0)
            classed = [places[:, f] + np.where(y > 0, 0, size) for f in range(d)]
            for m in range(fits):
                weight = n * np.exp(-0.5 * sign * _score(tables[m], places)) * (folds != held[m])
                for f in range(d):
                    out[m, :, f] += np.bincount(classed[f], weight, minlength=2 * size).reshape(2, size)
        fit, kind, feature, place = np.nonzero(out)
        cols = [pa.array(x.astype(np.int32)) for x in (fit, kind, feature, place)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(out[fit, kind, feature, place])], names=["fit", "kind", "feature", "place", "weight"])

    return run


def grow(placed: DataFrame, cuts: list[np.ndarray], fits: Sequence[Fit]) -> None:
    """All rounds of all fits; a round is one pass for those that are not done."""
    spark = placed.sparkSession
    places = [len(c) + 1 for c in cuts]
    while True:
        moving = [f for f in fits if not f.done]
        if not moving:
            return
        held = np.array([-2 if f.held is None else f.held for f in moving])
        sent = spark.sparkContext.broadcast((np.array([f.tables for f in moving]), held))
        sums = placed.mapInArrow(_histograms(sent), "fit int, kind int, feature int, place int, weight double")
        weights = np.zeros((len(moving), 2, len(cuts), max(places)))
        for r in sums.groupBy("fit", "kind", "feature", "place").agg(F.sum("weight")).collect():  # fits x features x places
            weights[r[0], r[1], r[2], r[3]] = r[4]
        sent.unpersist()
        for fit, (positive, negative) in zip(moving, weights, strict=True):
            fit.add(positive, negative, places)


def new_fit(cuts: list[np.ndarray], n_estimators: int = 50, learning_rate: float = 1.0, held: int | None = None) -> Fit:
    if int(n_estimators) < 1 or not learning_rate > 0:
        raise ValueError("n_estimators and learning_rate must be positive")
    return Fit(int(n_estimators), float(learning_rate), held, np.zeros((len(cuts), max(len(c) + 1 for c in cuts))))


def fit_adaboost(
    df: DataFrame, features: Sequence[str], label: str, *, n_estimators: int = 50, learning_rate: float = 1.0, places: int = PLACES
) -> ExpressionModel:
    """Each round fits a stump to the weighted rows and raises the weight of the rows it gets wrong.

    Stumps at the same threshold are added up, so the model has at most as many terms as there are thresholds.
    """
    features = list(features)
    cuts = cut_points(df, features, places)
    fit = new_fit(cuts, n_estimators, learning_rate)
    placed = placed_rows(df, features, label, cuts)
    grow(placed, cuts, [fit])
    discard(placed)
    if not fit.stumps:
        raise ValueError("no stump does better than chance")
    total = sum(fit.alphas)
    start, rises = 0.0, {}
    for alpha, (f, last, left, right) in zip(fit.alphas, fit.stumps, strict=True):
        start += alpha * left
        if last < len(cuts[f]):
            rises[f, last] = rises.get((f, last), 0.0) + alpha * (right - left)
    margin = F.lit(start / total)
    for (f, last), rise in sorted(rises.items()):
        margin = margin + F.when(F.col(features[f]).cast("double") > F.lit(float(cuts[f][last])), F.lit(rise / total)).otherwise(F.lit(0.0))
    return ExpressionModel(features, margin, detail={"alphas": fit.alphas, "stumps": [(features[f], float(cuts[f][k]) if k < len(cuts[f]) else math.inf) for f, k, _, _ in fit.stumps]})


def _verdicts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, keys = sent.value
        cells = np.zeros((len(keys), 4), np.int64)
        for batch in batches:
            folds, y, places, n = _columns(batch)
            for m, (_, fold) in enumerate(keys):
                mine = folds == fold
                positive = _score(tables[m], places[mine]) > 0
                cell = np.where(y[mine] > 0, np.where(positive, 0, 2), np.where(positive, 1, 3))
                cells[m] += np.bincount(cell, n[mine], minlength=4).astype(np.int64)
        trial, fold = (np.array(x, np.int32) for x in zip(*keys, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(trial), *(pa.array(c) for c in cells.T.copy())], names=["fold", "trial", "tp", "fp", "fn", "tn"])

    return run


def adaboost_candidates(folded: DataFrame, features: Sequence[str], label: str, candidates: Sequence[Mapping], folds: int) -> Outcome:
    """All candidates on all folds together: as many passes as the longest of them has rounds."""
    cuts = cut_points(folded, features)
    fits, failed = {}, {}
    for t, params in enumerate(candidates):
        for f in range(folds):
            try:
                fits[t, f] = new_fit(cuts, held=f, **params)
            except (ValueError, TypeError) as e:  # recorded as a row; the other candidates go on
                failed[t, f] = f"{type(e).__name__}: {e}"
    if not fits:
        return folded.sparkSession.createDataFrame([], COUNTS), failed
    placed = placed_rows(folded, features, label, cuts, "fold")
    grow(placed, cuts, list(fits.values()))
    for key, fit in list(fits.items()):
        if not fit.stumps:
            failed[key] = "ValueError: no stump does better than chance"
            del fits[key]
    if not fits:
        return folded.sparkSession.createDataFrame([], COUNTS), failed
    sent = folded.sparkSession.sparkContext.broadcast((np.array([f.tables for f in fits.values()]), list(fits)))
    cells = ("tp", "fp", "fn", "tn")
    return placed.mapInArrow(_verdicts(sent), COUNTS).groupBy("fold", "trial").agg(*[F.sum(c).alias(c) for c in cells]), failed
