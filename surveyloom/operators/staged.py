"""Boosted trees scored at every number of trees, and early stopping on the area under the curve.

A row's margins after 1, 2, ... trees are the running sums of what each tree adds, so one array column holds the scores of all shorter models
of a boosted one, and one job gives the AUC of each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import binary_label, whole
from surveyloom.operators.classifiers.boosted_trees import BoostedTrees, PackedTrees
from surveyloom.operators.classifiers.trees import fit_boosting
from surveyloom.operators.rank import prefix_sums
from surveyloom.session import discard, materialize


def pack(model: BoostedTrees) -> PackedTrees:
    """The trees of a fitted boosted model."""
    return model.packed


def staged_auc(df: DataFrame, label: str, margins: str = "margins", count: str | None = None) -> DataFrame:
    """(trees, auc): the area under the curve after each number of trees, null when a class is absent. ``count`` says how many rows a row stands for.

    Scores are counted per distinct value with running sums, as in ``roc_auc``, for all numbers of trees together.
    """
    n = F.col(count) if count else F.lit(1)
    each = df.select(binary_label(label).alias("_y"), n.cast("long").alias("_n"), F.posexplode(margins).alias("_k", "_s"))
    rows = [F.sum(F.when(F.col("_y") == y, F.col("_n")).otherwise(0)).alias(name) for y, name in ((1, "_p"), (0, "_q"))]
    counted = each.groupBy("_k", "_s").agg(*rows)
    summed = prefix_sums(counted, "_s", ["_q"], "_k")
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    auc = F.try_divide(F.sum(p * (F.col("_q_before") + q / 2)), F.sum(p) * F.sum(q))
    return summed.groupBy((F.col("_k") + 1).alias("trees")).agg(auc.alias("auc"))


def best_prefix(aucs: Sequence[float], patience: int) -> tuple[int, bool]:
    """The number of trees with the best AUC (the fewest among equals), going on until ``patience`` further trees bring no better one.

    Second, whether that end was reached.
    """
    best, at = -1.0, 0
    for k, auc in enumerate(aucs):
        if auc > best + 1e-12:
            best, at = auc, k
        elif k - at >= patience:
            return at + 1, True
    return at + 1, False


def fit_boosting_early_stop(
    train: DataFrame, validation: DataFrame, features: Sequence[str], label: str, *, n_estimators: int = 500, patience: int = 100, **options
) -> tuple[PackedTrees, DataFrame]:
    """Boosted trees up to the best AUC on the validation rows; and (trees, auc) of all numbers of trees that were looked at.

    The first trees of a longer fit are those of a shorter one, so fits of doubling length are tried until patience runs out. Equal validation rows are
    scored as one counted row.
    """
    slim = validation.select(*features, label)
    counted = materialize(slim.groupBy(*slim.columns).agg(F.count("*").alias("_n")), "validation-rows", spread=True)
    size = min(n_estimators, patience + max(1, patience // 4))
    while True:
        packed = pack(fit_boosting(train, features, label, n_estimators=size, **options))
        scored = staged_auc(packed.staged_margins(counted), label, count="_n")
        rows = sorted((r["trees"], r["auc"]) for r in scored.collect())  # one row per tree
        if not rows or any(a is None for _, a in rows):
            raise ValueError("the validation rows must hold both classes")
        best, ended = best_prefix([a for _, a in rows], patience)
        if ended or size >= n_estimators or len(rows) < size:
            discard(counted)
            return packed.prefix(best), train.sparkSession.createDataFrame(rows, "trees int, auc double")
        size = min(n_estimators, 2 * size)
