"""Input that used to give silent wrong answers: missing features, other labels, NaN, endless draws, wide paths."""

import math

import numpy as np
import pytest

from surveyloom.operators import encoding, explain, metrics, profile, sampling, tuning
from surveyloom.operators.classifiers import bayes, boosted_stumps, linear, perceptron, random_trees, trees
from surveyloom.operators.spaces import Choice, Real, Whole, draw_params

ROWS = [(k, float(k % 7), float(k % 3), int(k % 7 > 3)) for k in range(60)]
LEARNERS = [
    linear.fit_logistic, linear.fit_svm, trees.fit_forest, trees.fit_tree, lambda df, f, y: trees.fit_boosting(df, f, y, n_estimators=2),
    lambda df, f, y: perceptron.fit_perceptron(df, f, y, max_iter=2), lambda df, f, y: random_trees.fit_extra_trees(df, f, y, n_estimators=2),
]
FITS = [bayes.fit_bayes, linear.fit_discriminant, lambda df, f, y: boosted_stumps.fit_adaboost(df, f, y, n_estimators=2)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "k long, a double, b double, label int")


@pytest.mark.parametrize("fit", FITS)
@pytest.mark.parametrize("gap", [None, float("nan")])
def test_a_missing_feature_fails(spark, table, fit, gap):
    model = fit(table, ["a", "b"], "label")
    assert model.predict(table).count() == 60
    with pytest.raises(Exception, match="is missing"):
        model.predict(spark.createDataFrame([(1, gap, 1.0, 0)], table.schema)).collect()


@pytest.mark.parametrize("fit", FITS)
@pytest.mark.parametrize("other", [2, None])
def test_other_labels_fail(spark, table, fit, other):
    with pytest.raises(Exception, match="must be 0 or 1"):
        fit(table.union(spark.createDataFrame([(99, 1.0, 1.0, other)], table.schema)), ["a", "b"], "label")


@pytest.mark.parametrize("fit", [*LEARNERS, *FITS])
def test_training_rows_are_checked(spark, table, fit):
    with pytest.raises(Exception, match="must be 0 or 1"):
        fit(table.union(spark.createDataFrame([(99, 1.0, 1.0, 2)], table.schema)), ["a", "b"], "label")
    with pytest.raises(Exception, match="(?i)is missing|null|nan"):
        fit(table.union(spark.createDataFrame([(99, None, 1.0, 1)], table.schema)), ["a", "b"], "label").predict(table).count()


@pytest.mark.parametrize("row", [(2, 0.5), (None, 0.5), (1, None), (0, float("nan"))])
def test_other_scores_fail(spark, row):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), row], "label int, score double")
    for report in (metrics.roc_auc, metrics.log_loss):
        with pytest.raises(Exception, match="must be 0 or 1"):
            report(df, "label", "score").collect()


def test_other_labels_have_no_accuracy(spark):
    with pytest.raises(Exception, match="must be 0 or 1"):
        metrics.accuracy(spark.createDataFrame([(1, 1), (2, 1)], "label int, prediction int"), "label", "prediction").collect()


def test_boolean_labels_train(table):
    model = bayes.fit_bayes(table.selectExpr("k", "a", "b", "label = 1 as label"), ["a", "b"], "label")
    assert model.predict(table).where("prediction = label").count() > 50


@pytest.mark.parametrize("row", [(2, 1), (1, 2), (None, 1), (0, None)])
def test_other_predictions_fail(spark, row):
    df = spark.createDataFrame([(1, 1), (0, 1), row], "label int, prediction int")
    for report in (metrics.binary_metrics, metrics.class_report, metrics.confusion_matrix, metrics.f1_weighted):
        with pytest.raises(Exception, match="must be 0 or 1"):
            report(df, "label", "prediction").collect()


def test_nan_is_a_gap(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (3.0, 3), (None, 4)], "x double, y int")
    assert [tuple(r) for r in profile.null_report(df).collect()] == [("x", 2, 50.0)]
    x = profile.describe_numeric(df).where("feature = 'x'").first()
    assert (x["n"], x["mean"], x["max"], x["q50"]) == (2, 2.0, 3.0, 2.0)
    assert {r["column_name"]: r["non_null"] for r in profile.column_info(df).collect()} == {"x": 2, "y": 4}
    rho = {(r[0], r[1]): r[2] for r in profile.spearman_matrix(df).collect()}
    assert rho["x", "y"] == pytest.approx(1.0)


def test_draws_end():
    assert draw_params({"a": Real(1.0, 1.0)}, 5) == [{"a": 1.0}]
    assert len(draw_params({"a": Choice((1, 1, 2)), "b": Whole(3, 3)}, 5)) == 2


def test_wide_paths_are_refused():
    wide = np.arange(63)
    with pytest.raises(ValueError, match="62 features"):
        explain.Leaf(wide, wide, wide, 1.0)


def test_text_keys(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x"), ("d", "z")], "k string, v string")
    assert {r["v"]: r["code"] for r in encoding.code_table(df, "v", "k").collect()} == {"y": 0, "x": 1, "z": 2}
    assert [r["k"] for r in sampling.sample_range(df, "k", 1, 1, 2).collect()] == ["b", "c"]


def test_repeated_keys_cannot_be_sampled(spark):
    df = spark.createDataFrame([(1,)] * 20, "k long")
    with pytest.raises(ValueError, match="not unique"):
        sampling.sample_n(df, "k", 5)


def test_best_trial_skips_failures_and_breaks_ties(spark):
    rows = [("m", t, f, s, {"p": str(t)}, e) for t, f, s, e in [
        (0, 0, 0.9, None), (0, 1, None, "failed"), (1, 0, 0.25, None), (1, 1, 0.75, None), (2, 0, 0.5, None), (2, 1, 0.5, None), (3, 0, math.nan, None),
    ]]
    best = tuning.best_trial(spark.createDataFrame(rows, tuning.TRIALS)).collect()
    assert [(r["trial"], r["score"], r["params"]) for r in best] == [(1, 0.5, {"p": "1"})]
