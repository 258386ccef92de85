"""Cross-validation, parameter search and model comparison.

Each evaluation is a Spark fit on a cached training frame with a fold column; a few run at a time.
Only parameter maps and scores are kept on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.operators.explain import lime_explain, quartile_bins
from surveyloom.operators.metrics import binary_metrics, class_report, confusion_matrix, metric_columns, roc_auc
from surveyloom.operators.spaces import Family, density_draws, draw_params
from surveyloom.operators.splits import stratified_kfold

SCORES = ("accuracy", "precision", "recall", "f1", "f1_weighted", "roc_auc")

TRIALS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("trial", T.IntegerType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("accuracy", "precision", "recall", "f1", "cv_mean", "cv_std")],
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class Task:
    """What is learned: the column roles and how candidates are scored."""

    features: Sequence[str]
    label: str
    key: str
    scoring: str = "f1_weighted"
    folds: int = 5
    seed: int = 42
    parallelism: int = 4

    def __post_init__(self) -> None:
        if self.scoring not in SCORES:
            raise ValueError(f"scoring must be one of {SCORES}")


@dataclass
class Search:
    """Outcome of a search: one row per trial and fold, the best parameters and their mean score."""

    trials: DataFrame
    rows: list[tuple]
    best: dict | None
    score: float | None
    fold_scores: list[float] = field(default_factory=list)
    means: dict[int, float] = field(default_factory=dict)  # mean score of each trial without a failed fold


def text_map(params: Mapping[str, Any]) -> dict[str, str]:
    return {k: str(v) for k, v in params.items()}


def score_of(scored: DataFrame, task: Task) -> float:
    if task.scoring == "roc_auc":
        return roc_auc(scored, task.label, "probability").first()["auc"]
    return binary_metrics(scored, task.label, "prediction").first()[task.scoring]


def with_folds(df: DataFrame, task: Task) -> DataFrame:
    """The columns a search needs, with fold numbers, cached. The caller unpersists it."""
    slim = df.select(task.key, task.label, *task.features)
    return stratified_kfold(slim, task.key, task.label, task.folds, task.seed).persist()


def cross_validate(folded: DataFrame, family: Family, candidates: Sequence[Mapping], task: Task, start: int = 0) -> Search:
    """Score every candidate on every fold; a failing fit leaves a null score and its message.

    Families that can, fit and score all candidates on all folds together; others take a fit per candidate and fold.
    """
    spark = folded.sparkSession
    if family.many is not None and task.scoring != "roc_auc":
        return _together(folded, family, candidates, task, start)

    def one(job: tuple[int, Mapping, int]) -> tuple:
        trial, params, fold = job
        try:
            model = family.train(folded.where(F.col("fold") != fold), task.features, task.label, task.key, params)
            score, error = score_of(model.predict(folded.where(F.col("fold") == fold)), task), None
        except Exception as e:  # recorded as a row; the other candidates go on
            score, error = None, f"{type(e).__name__}: {e}"
        return family.name, trial, fold, score, text_map(params), error

    jobs = [(start + i, p, f) for i, p in enumerate(candidates) for f in range(task.folds)]
    with ThreadPoolExecutor(max(1, task.parallelism)) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), jobs))
    return _summed(spark, rows, {start + i: dict(p) for i, p in enumerate(candidates)})


def _together(folded: DataFrame, family: Family, candidates: Sequence[Mapping], task: Task, start: int) -> Search:
    cells, failed = family.many(folded, task.features, task.label, candidates, task.folds)
    scores = {(r["trial"], r["fold"]): r["score"] for r in cells.select("fold", "trial", *metric_columns()).withColumn("score", F.col(task.scoring)).collect()}
    rows = [
        (family.name, start + t, f, scores.get((t, f)), text_map(candidates[t]), failed.get((t, f)))
        for t in range(len(candidates))
        for f in range(task.folds)
    ]
    return _summed(folded.sparkSession, rows, {start + t: dict(p) for t, p in enumerate(candidates)})


def _summed(spark: SparkSession, rows: list[tuple], params: dict[int, dict]) -> Search:
    scores: dict[int, list[float]] = {}
    for _, trial, _, score, _, error in rows:
        scores.setdefault(trial, []).append(math.nan if error or score is None else score)
    means = {t: sum(s) / len(s) for t, s in scores.items()}
    valid = [t for t, m in means.items() if not math.isnan(m)]
    best = min(valid, key=lambda t: (-means[t], t)) if valid else None
    trials = spark.createDataFrame(rows, TRIALS)
    if best is None:
        return Search(trials, rows, None, None)
    return Search(trials, rows, params[best], means[best], scores[best], {t: means[t] for t in valid})


def best_trial(trials: DataFrame) -> DataFrame:
    """(model, trial, score, params) of the trial with the highest mean score (to 12 digits) over its folds, the first one on ties.

    Trials of which a fold failed are left out.
    """
    failed = F.col("error").isNotNull() | F.col("score").isNull() | F.isnan("score")
    means = trials.groupBy("model", "trial").agg(
        F.round(F.avg("score"), 12).alias("score"), F.any_value("params").alias("params"), F.count_if(failed).alias("failed")
    )
    return means.where("failed = 0").orderBy(F.desc("score"), "trial").limit(1).drop("failed").select("model", "trial", "score", "params")


def random_search(folded: DataFrame, family: Family, task: Task, n_iter: int) -> Search:
    """Draw n_iter parameter maps and cross-validate each."""
    return cross_validate(folded, family, draw_params(family.space, n_iter, task.seed), task)


def space_search(folded: DataFrame, family: Family, task: Task, n_trials: int, rounds: int = 8) -> Search:
    """Search a declared space in rounds: the first draws evenly, each later one where good trials are denser than the others."""
    spark = folded.sparkSession
    rows, params = [], {}
    search = Search(spark.createDataFrame([], TRIALS), [], None, None)
    rounds = max(1, min(rounds, n_trials))
    for r in range(rounds):
        n = n_trials // rounds + (1 if r < n_trials % rounds else 0)
        candidates = density_draws(family.space, [(params[t], m) for t, m in search.means.items()], n, task.seed + r)
        if not candidates:
            break
        part = cross_validate(folded, family, candidates, task, start=len(params))
        params.update({len(params) + i: p for i, p in enumerate(candidates)})
        rows = rows + part.rows
        search = _summed(spark, rows, params)
    return search


def report_best(train: DataFrame, test: DataFrame, family: Family, params: Mapping[str, Any], task: Task) -> dict[str, DataFrame]:
    """The best parameters fitted to all training rows and judged on the test rows: ``params``, ``report`` and ``confusion``, and the ``model``."""
    spark = train.sparkSession
    model = family.train(train, task.features, task.label, task.key, params)
    judged = model.predict(test)
    table = [(family.name, k, v) for k, v in text_map(params).items()]
    return {
        "model": model,
        "params": spark.createDataFrame(table, "model string, name string, value string"),
        "report": class_report(judged, task.label, "prediction", totals=True),
        "confusion": confusion_matrix(judged, task.label, "prediction"),
    }


def compare_models(
    train: DataFrame,
    test: DataFrame,
    families: Sequence[Family],
    task: Task,
    n_iter: int = 20,
    rounds: int = 1,
    digits: int = 4,
) -> tuple[DataFrame, dict[str, Any]]:
    """Tune each family, refit its best parameters on all training rows, and score the test rows.

    Returns the result table and the fitted models. A family without a space is fitted as it is. One
    that fails gets a row with the message and null scores.
    """
    spark = train.sparkSession
    folded = with_folds(train, task)
    rows, models = [], {}
    try:
        for family in families:
            if not family.space:
                found = cross_validate(folded, family, [{}], task)
            elif rounds > 1:
                found = space_search(folded, family, task, n_iter, rounds)
            else:
                found = random_search(folded, family, task, n_iter)
            if found.best is None:
                first = next((r[5] for r in found.rows if r[5]), "no trial gave a score")
                rows.append((family.name, *[None] * 6, None, first))
                continue
            try:
                model = family.train(folded, task.features, task.label, task.key, found.best)
                m = binary_metrics(model.predict(test), task.label, "prediction").first()
                accuracy = found
                if task.scoring != "accuracy":
                    accuracy = cross_validate(folded, family, [found.best], replace(task, scoring="accuracy"))
                s = accuracy.fold_scores
                mean = sum(s) / len(s)
                std = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
            except Exception as e:  # recorded as a row; the other families go on
                rows.append((family.name, *[None] * 6, None, f"{type(e).__name__}: {e}"))
                continue
            values = [m["accuracy"], m["precision"], m["recall"], m["f1"], mean, std]
            rows.append((family.name, *[round(v, digits) for v in values], text_map(found.best), None))
            models[family.name] = model
    finally:
        folded.unpersist()
    return spark.createDataFrame(rows, RESULTS), models


def ablation_report(
    train: DataFrame,
    test: DataFrame,
    rows: DataFrame,
    family: Family,
    params: Mapping[str, Any],
    task: Task,
    dropped: str,
    n_samples: int = 5000,
) -> DataFrame:
    """The model with and without one feature: test accuracy and F1, and the mean absolute local weight per feature.

    (variant, accuracy, f1, feature, mean_abs_weight), with the local weights taken over the given rows.
    """
    parts = []
    bins = quartile_bins(train, task.features)  # a feature's bins don't depend on the others: both variants share them
    for variant, features in (
        ("all features", list(task.features)),
        (f"without {dropped}", [c for c in task.features if c != dropped]),
    ):
        model = family.train(train, features, task.label, task.key, params)
        m = binary_metrics(model.predict(test), task.label, "prediction").first()
        weights = lime_explain(model, train, rows, features, task.key, n_samples, bins=bins)
        parts.append(
            weights.groupBy("feature")
            .agg(F.avg(F.abs("weight")).alias("mean_abs_weight"))
            .select(F.lit(variant).alias("variant"), F.lit(m["accuracy"]).alias("accuracy"), F.lit(m["f1"]).alias("f1"), "feature", "mean_abs_weight")
        )
    return parts[0].unionByName(parts[1])
