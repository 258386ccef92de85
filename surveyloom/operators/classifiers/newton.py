"""Logistic regression by Newton steps on sums, for any number of problems over one table.

A problem is a penalty together with a fold that is left out (or none). In each pass tasks add up, for every problem that is still
moving, the loss, its slope and its curvature over the problem's rows; these have the size of the features squared. The
driver minimises each quadratic model with its penalty (by coordinates where there is an l1 part) and halves a step that
raised the objective. So a search over many strengths and folds reads the table a dozen times, not a dozen times per fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import binary_label, whole
from surveyloom.operators.classifiers.candidates import MARGINS, Margin, Models, Outcome, outcome
from surveyloom.session import deal, discard, materialize

# Share of the l1 part in each penalty; None for elasticnet: it is a parameter.
MIXES = {"l1": 1.0, "l2": 0.0, "elasticnet": None, None: 0.0}


@dataclass(frozen=True)
class Problem:
    """Sum of the log losses + ridge / 2 |w|^2 + lasso |w|_1, over all rows outside the fold ``held``."""

    ridge: float
    lasso: float
    intercept: bool = True
    held: int | None = None


def problem(C: float = 1.0, penalty: str | None = "l2", l1_ratio: float = 0.5, fit_intercept: bool = True, held: int | None = None) -> Problem:
    if penalty not in MIXES:
        raise ValueError(f"unknown penalty {penalty}")
    mix = float(l1_ratio) if penalty == "elasticnet" else MIXES[penalty]
    strength = 0.0 if penalty is None else 1.0 / float(C)
    return Problem(strength * (1 - mix), strength * mix, bool(fit_intercept), held)


def counted_rows(df: DataFrame, features: Sequence[str], label: str, fold: str | None = None) -> DataFrame:
    """(fold, y, features, n): equal rows become one counted row, stored over all cores; a loss is a sum over rows, which this leaves as it is."""
    x = [whole(F.col(c).cast("double"), features).alias(f"x{i}") for i, c in enumerate(features)]
    mark = F.lit(-1) if fold is None else F.col(fold)
    slim = df.select(mark.cast("int").alias("_f"), binary_label(label).cast("double").alias("_y"), *x)
    return deal(materialize(slim.groupBy(*slim.columns).agg(F.count("*").cast("double").alias("_n")), "counted-rows"), "counted-rows")


def _sums(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held = sent.value  # [problems, d + 1], [problems]
        many, width = weights.shape
        upper = np.triu_indices(width)
        out = np.zeros((many, 1 + width + len(upper[0])))
        step = max(1, MARGINS // many)
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(a, step)
                folds, y, *cols, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                x = np.column_stack([*cols, np.ones(len(y))])
                margin = x @ weights.T
                mass = n[:, None] * (folds[:, None] != held)
                p = 0.5 * (1 + np.tanh(0.5 * margin))
                out[:, 0] += (mass * (np.logaddexp(0, margin) - y[:, None] * margin)).sum(axis=0)
                out[:, 1 : 1 + width] += (mass * (p - y[:, None])).T @ x
                out[:, 1 + width :] += (mass * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
        places = out.shape[1]
        number, place = np.repeat(np.arange(many, dtype=np.int32), places), np.tile(np.arange(places, dtype=np.int32), many)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place), pa.array(out.ravel())], names=["problem", "place", "value"])

    return run


def _soft(x: float, by: float) -> float:
    return np.sign(x) * max(abs(x) - by, 0.0)


def _step(p: Problem, w: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The step that minimises the quadratic model of the loss with the penalty."""
    free = np.append(np.zeros(len(w) - 1), 1.0)  # the intercept has no penalty
    used = np.arange(len(w) if p.intercept else len(w) - 1)
    full = curve + np.diag(p.ridge * (1 - free))
    pull = slope + p.ridge * (1 - free) * w
    out = np.zeros(len(w))
    if not p.lasso:
        out[used] = -np.linalg.lstsq(full[np.ix_(used, used)], pull[used], rcond=1e-12)[0]
        return out
    for _ in range(500):
        most = 0.0
        for i in used:
            if full[i, i] <= 0:
                continue
            rest = pull[i] + full[i] @ out - full[i, i] * out[i]
            target = w[i] - rest / full[i, i]
            best = (target if free[i] else _soft(target, p.lasso / full[i, i])) - w[i]
            most, out[i] = max(most, abs(best - out[i])), best
        if most < 1e-12:
            break
    return out


def solve(counted: DataFrame, width: int, problems: Sequence[Problem], max_iter: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Weights and, last, the intercept of every problem: [problems, width + 1]."""
    spark = counted.sparkSession
    d = width + 1
    upper = np.triu_indices(d)
    best, step = np.zeros((len(problems), d)), np.zeros((len(problems), d))
    value, part = np.full(len(problems), np.inf), np.ones(len(problems))
    moving = list(range(len(problems)))
    for _ in range(max_iter):
        if not moving:
            break
        tried = best[moving] + part[moving, None] * step[moving]
        held = np.array([-2 if problems[k].held is None else problems[k].held for k in moving])
        sent = spark.sparkContext.broadcast((tried, held))
        sums = counted.mapInArrow(_sums(sent), "problem int, place int, value double").groupBy("problem", "place").agg(F.sum("value").alias("value"))
        out = np.zeros((len(moving), 1 + d + len(upper[0])))
        for r in sums.collect():  # problems x features squared
            out[r["problem"], r["place"]] = r["value"]
        sent.unpersist()
        later = []
        for row, k in enumerate(moving):
            p, w = problems[k], tried[row]
            now = out[row, 0] + 0.5 * p.ridge * w[:-1] @ w[:-1] + p.lasso * np.abs(w[:-1]).sum()
            if now > value[k] + 1e-12 * abs(value[k]) and part[k] > 1e-9:
                part[k] /= 2
                later.append(k)
                continue
            best[k], value[k] = w, now
            curve = np.zeros((d, d))
            curve[upper] = out[row, 1 + d :]
            curve = curve + np.triu(curve, 1).T
            step[k], part[k] = _step(p, w, out[row, 1 : 1 + d], curve), 1.0
            if np.abs(step[k]).max() > tolerance * max(1.0, np.abs(w).max()):
                later.append(k)
        moving = later
    return best


def logistic_candidates(folded: DataFrame, features: Sequence[str], label: str, candidates: Sequence[Mapping], folds: int) -> Outcome:
    """All candidates on all folds together."""
    out: Models = {}
    keys, problems = [], []
    for t, params in enumerate(candidates):
        for f in range(folds):
            try:
                problems.append(problem(**params, held=f))
                keys.append((t, f))
            except (ValueError, TypeError) as e:  # recorded as a row; the other candidates go on
                out[t, f] = f"{type(e).__name__}: {e}"
    if keys:
        d = len(features)
        counted = counted_rows(folded, features, label, "fold")
        for key, w in zip(keys, solve(counted, d, problems), strict=True):
            out[key] = Margin(np.zeros(d), np.zeros(d), w[:-1], float(w[-1]))
        discard(counted)
    return outcome(folded, features, label, out)
