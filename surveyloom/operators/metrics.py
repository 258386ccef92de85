"""Classification metrics. Everything except AUC and log loss derives from one row of confusion counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.scalars import label_name, ratio
from surveyloom.operators.rank import prefix_sums


def _cell(label: str, pred: str, actual: int, guess: int) -> Column:
    return F.count_if((F.col(label).cast("double") == actual) & (F.col(pred).cast("double") == guess))


def confusion_counts(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn in one pass, over the table or per group. Labels and predictions other than 0 and 1, null too,
    make the query fail."""
    known = F.col(label).cast("double").isin(0.0, 1.0) & F.col(pred).cast("double").isin(0.0, 1.0)
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    counts = df.groupBy(*by).agg(
        *[_cell(label, pred, a, p).alias(c) for c, (a, p) in cells.items()],
        F.count_if(~F.coalesce(known, F.lit(False))).alias("_others"),
    )
    problem = F.raise_error(F.lit(f"{label} and {pred} must be 0 or 1 in every row")).cast("long")
    return counts.select(*by, *[F.when(F.col("_others") > 0, problem).otherwise(F.col(c)).alias(c) for c in cells])


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted, n) with all four pairs present."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return confusion_counts(df, label, pred).select(F.inline(F.array(*cells)))


def _counts() -> tuple[Column, Column, Column, Column]:
    return F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")


def accuracy_of() -> Column:
    tp, fp, fn, tn = _counts()
    return F.try_divide((tp + tn).cast("double"), (tp + fp + fn + tn).cast("double"))


def f1_weighted_of() -> Column:
    tp, fp, fn, tn = _counts()
    f_pos = ratio(2 * tp, 2 * tp + fp + fn)
    f_neg = ratio(2 * tn, 2 * tn + fp + fn)
    return F.try_divide(f_pos * (tp + fn) + f_neg * (tn + fp), (tp + fp + fn + tn).cast("double"))


def metric_columns() -> list[Column]:
    """accuracy, precision, recall and F1 of the positive class (0 where undefined), weighted F1."""
    tp, fp, fn, _ = _counts()
    return [
        accuracy_of().alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        f1_weighted_of().alias("f1_weighted"),
    ]


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return confusion_counts(df, label, pred).select(accuracy_of().alias("accuracy"))


def _scored(df: DataFrame, label: str, score: str) -> DataFrame:
    """(y, s): other labels than 0 and 1, and missing scores, make the query fail."""
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    sound = y.isin(0.0, 1.0) & s.isNotNull() & ~F.isnan(s)
    problem = F.raise_error(F.lit(f"{label} must be 0 or 1 and {score} a number in every row")).cast("double")
    return df.select(F.when(F.coalesce(sound, F.lit(False)), y).otherwise(problem).alias("_y"), s.alias("_s"))


def binary_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 and weighted f1, over the table or per group."""
    return confusion_counts(df, label, pred, by).select(*by, *metric_columns())


def f1_weighted(df: DataFrame, label: str, pred: str) -> DataFrame:
    return confusion_counts(df, label, pred).select(f1_weighted_of().alias("f1_weighted"))


def class_report(
    df: DataFrame, label: str, pred: str, names: Mapping[int, str] | None = None, totals: bool = False
) -> DataFrame:
    """Precision, recall, F1 and support per class; ``totals=True`` adds the macro and weighted averages."""
    tp, fp, fn, tn = _counts()
    fields = ("class_name", "precision", "recall", "f1", "support")

    def row(*values: Column) -> Column:
        return F.struct(*[v.alias(c) for v, c in zip(values, fields)])

    def measures(hit: Column, wrong: Column, missed: Column) -> list[Column]:
        return [ratio(hit, hit + wrong), ratio(hit, hit + missed), ratio(2 * hit, 2 * hit + wrong + missed)]

    negative, positive = measures(tn, fn, fp), measures(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    rows = [
        row(label_name(F.lit(c), names or {}), *m, n) for c, m, n in ((0, negative, n0), (1, positive, n1))
    ]
    if totals:
        macro = [(a + b) / 2 for a, b in zip(negative, positive)]
        weighted = [ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(negative, positive)]
        rows += [row(F.lit("macro avg"), *macro, n0 + n1), row(F.lit("weighted avg"), *weighted, n0 + n1)]
    return confusion_counts(df, label, pred).select(F.inline(F.array(*rows)))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order, ties half.

    Counted per distinct score with running sums, so no pair is formed. Null when a class is absent.
    """
    counted = _scored(df, label, score).groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") == 0).alias("_q"))
    summed = prefix_sums(counted, "_s", ["_q"])
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    won = F.sum(p * (F.col("_q_before") + q / 2))
    return summed.agg(F.try_divide(won, F.sum(p) * F.sum(q)).alias("auc"))


def log_loss(df: DataFrame, label: str, prob: str, eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood of the label, probabilities clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col("_s"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("_y")
    return _scored(df, label, prob).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def cv_summary(trials: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Mean and population std of the fold scores, to 4 digits."""
    return trials.groupBy(*by).agg(
        F.round(F.avg(score), 4).alias("cv_mean"), F.round(F.stddev_pop(score), 4).alias("cv_std")
    )


def best_model(results: DataFrame, score: str = "accuracy", name: str = "model") -> DataFrame:
    """The valid row with the highest score (first name on ties); no row when none is valid."""
    valid = results.where(F.col(score).isNotNull())
    if "error" in results.columns:
        valid = valid.where(F.col("error").isNull())
    return valid.orderBy(F.desc(score), name).limit(1)
