"""Tree classifiers: one tree and forests by Spark's distributed tree trainer, boosted trees by ``boosted_trees``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import DataFrame

from surveyloom.operators.classifiers.base import VECTOR, PipelineClassifier, binary_label, fit_pipeline
from surveyloom.operators.classifiers.boosted_trees import BoostedTrees, Plan, boost

# Spark's own limit on tree depth; stands for "no limit".
DEEPEST = 30


def _depth(depth: int | None) -> int:
    return DEEPEST if depth is None else min(int(depth), DEEPEST)


def _impurity(criterion: str) -> str:
    return "gini" if criterion == "gini" else "entropy"


def _fit(df: DataFrame, features: Sequence[str], label: str, estimator) -> PipelineClassifier:
    """Labels other than 0 and 1 make the fit fail, as missing features do in the assembler."""
    return fit_pipeline(df.withColumn(label, binary_label(label).cast("double")), features, estimator)


def _common(label: str) -> dict:
    return {"featuresCol": VECTOR, "labelCol": label}


def fit_boosting(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    n_estimators: int = 500,
    max_depth: int | None = 3,
    learning_rate: float = 0.1,
    subsample: float = 0.8,
    colsample: float = 0.8,
    gamma: float = 0.0,
    num_leaves: int | None = None,
    seed: int = 1,
    validation: str | None = None,
    tolerance: float = 0.01,
) -> BoostedTrees:
    """Gradient-boosted trees.

    ``colsample`` is applied per node, ``gamma`` is the least gain of a split, and ``num_leaves`` (when
    given) sets the depth that holds so many leaves. ``validation`` names a boolean column; training
    stops when the loss on its rows no longer falls by ``tolerance``; ``staged`` stops on the AUC.
    """
    if int(n_estimators) < 1 or not 0 < learning_rate <= 1 or not 0 < subsample <= 1 or not 0 < colsample or gamma < 0:
        raise ValueError("n_estimators, learning_rate, subsample, colsample or gamma is out of range")
    depth = _depth(max_depth)
    if num_leaves:
        depth = min(depth, max(1, math.ceil(math.log2(num_leaves))))
    wanted = len(features) if colsample >= 1 else max(1, math.ceil(colsample * len(features)))

    def plan(places: tuple[int, ...]) -> Plan:
        stop = float(tolerance) if validation else None
        return Plan(int(n_estimators), depth, float(learning_rate), float(subsample), wanted, float(gamma), int(seed), places, stop)

    return boost(df, features, label, plan, validation)


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    n_estimators: int = 100,
    max_depth: int | None = 5,
    min_samples_leaf: int = 1,
    max_features: str | None = "sqrt",
    criterion: str = "gini",
    min_weight_fraction_leaf: float = 0.0,
    bootstrap: bool = True,
    max_bins: int = 64,
    seed: int = 1,
) -> PipelineClassifier:
    """Random forest."""
    if not 0 <= min_weight_fraction_leaf < 0.5:
        raise ValueError("min_weight_fraction_leaf must be in [0, 0.5)")
    est = RandomForestClassifier(
        **_common(label),
        numTrees=int(n_estimators),
        maxDepth=_depth(max_depth),
        minInstancesPerNode=int(min_samples_leaf),
        featureSubsetStrategy=max_features or "all",
        impurity=_impurity(criterion),
        minWeightFractionPerNode=float(min_weight_fraction_leaf),
        bootstrap=bool(bootstrap),
        maxBins=max_bins,
        seed=seed,
    )
    return _fit(df, features, label, est)


def fit_tree(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    max_depth: int | None = 5,
    min_samples_leaf: int = 1,
    criterion: str = "gini",
    seed: int = 1,
) -> PipelineClassifier:
    """One decision tree."""
    est = DecisionTreeClassifier(
        **_common(label),
        maxDepth=_depth(max_depth),
        minInstancesPerNode=int(min_samples_leaf),
        impurity=_impurity(criterion),
        maxBins=64,
        seed=seed,
    )
    return _fit(df, features, label, est)
