import datetime as dt

import pytest
from pyspark.sql import functions as F

from surveyloom.functions.scalars import percent_text
from surveyloom.operators import encoding, metrics, profile, sampling, series


def test_shares_have_two_denominators(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in profile.value_share(df, "v").collect()] == [("a", 2, 2 / 3), ("b", 1, 1 / 3)]
    assert [tuple(r) for r in profile.count_share_all(df, "v").collect()] == [("a", 2, 0.5), ("b", 1, 0.25)]


def test_group_count_drops_null_keys_unless_told(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 1)], "g string, l int")
    assert [tuple(r) for r in profile.group_count(df, ["g", "l"]).collect()] == [("a", 1, 2)]
    assert profile.group_count(df, ["g", "l"], dropna=False).count() == 2


def test_describe_with_an_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None)], "a int, b double")
    got = {r["feature"]: r for r in profile.describe_numeric(df).collect()}
    assert (got["a"]["q25"], got["a"]["q50"], got["a"]["q75"]) == (1.5, 2.0, 3.0)
    assert got["b"]["n"] == 0 and got["b"]["mean"] is None and got["b"]["q50"] is None
    near = {r["feature"]: r for r in profile.describe_numeric(df, approx=True).collect()}
    assert near["a"]["q50"] == 2.0


def test_null_report_lists_only_gaps(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b int, c string")
    assert [tuple(r) for r in profile.null_report(df).collect()] == [("b", 2, 100.0), ("c", 1, 50.0)]


def test_factorize_by_first_appearance(spark):
    fruit = ["apple", "orange", "banana", "apple", "banana", None]
    df = spark.createDataFrame(list(enumerate(fruit)), "k long, fruit string")
    got = {r["k"]: r["code"] for r in encoding.factorize(df, "fruit", "k").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 2, 5: -1}
    assert encoding.dimension_table(df, "fruit", "k").count() == 3
    assert encoding.dimension_table(df, "fruit", "k", dedup=False).count() == 6


def test_standard_score_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (3, 5.0)], "a int, b double")
    assert [tuple(r) for r in encoding.standardize(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize(
    "unit,texts,want",
    [
        ("day", ["2024-06-03", "2024-6-3", "2024-02-30", "x", None], [dt.datetime(2024, 6, 3)] * 2),
        ("month", ["2024-06", "2024-13"], [dt.datetime(2024, 6, 1)]),
        ("year", ["2024", "none"], [dt.datetime(2024, 1, 1)]),
        ("week", ["2024-06-03"], [dt.datetime(2024, 6, 3)]),
    ],
)
def test_dates_that_cannot_be_read_are_dropped(spark, unit, texts, want):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "k long, ds string, v double")
    got = series.dated_series(df, "k", "ds", "v", unit).orderBy("k").collect()
    assert [r["date"] for r in got] == want


def test_series_and_band_fall_back_to_the_key(spark):
    df = spark.createDataFrame([(2020, 1.0, 2.0)], "k long, close double, forecast double")
    assert series.dated_series(df, "k", "ds", "close", "year").first()["date"] == dt.datetime(2020, 1, 1)
    band = series.forecast_band(df, "k", "ds", "close", "forecast", "hi", "lo")
    assert band.columns == ["date", "original", "predicted"] and band.first()["date"] == 2020


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (0, 0, 0.2), (1, 0, 0.2)], "label int, p int, s double")
    m = metrics.binary_metrics(df, "label", "p").first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    assert metrics.roc_auc(df, "label", "s").first()["auc"] == 0.5
    only = df.where("label = 1")
    assert metrics.roc_auc(only, "label", "s").first()["auc"] is None
    assert [r["n"] for r in metrics.confusion_matrix(only, "label", "p").orderBy("actual", "predicted").collect()] == [0, 0, 2, 0]


def test_published_confusion_counts_give_their_own_accuracy(spark):
    cells = [(1, 1, 51), (0, 0, 55), (0, 1, 2), (1, 0, 14)]
    df = spark.createDataFrame([(a, p) for a, p, n in cells for _ in range(n)], "label int, p int")
    m = metrics.binary_metrics(df, "label", "p").first()
    assert m["accuracy"] == pytest.approx(106 / 122)
    assert m["precision"] == pytest.approx(51 / 53) and m["recall"] == pytest.approx(51 / 65)


def test_best_model_skips_errors_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.9, None), ("a", 0.9, None), ("c", None, "failed")], "model string, accuracy double, error string")
    assert metrics.best_model(df).first()["model"] == "a"
    assert metrics.best_model(df.where("model = 'c'")).count() == 0


def test_range_sample_and_alignment(spark):
    df = spark.range(0, 1000, 10).withColumnRenamed("id", "k")
    got = [(r["position"], r["k"]) for r in sampling.sample_range(df, "k", 5, 20, 7).collect()]
    assert len(set(got)) == 7 and got == sorted(got)
    assert all(5 <= p <= 25 and k == 10 * p for p, k in got)
    with pytest.raises(ValueError):
        sampling.sample_range(df, "k", 0, 3, 5)
    with pytest.raises(Exception, match="one to one"):
        sampling.align_by_key(df, df.limit(3).withColumn("y", F.lit(1)), "k").collect()


def test_large_samples_are_exact(spark):
    df = spark.range(30_000).withColumnRenamed("id", "k")
    assert sampling.sample_n(df, "k", 12_345, seed=4).count() == 12_345
    assert sampling.sample_n(df, "k", 40_000, seed=4).count() == 30_000


def test_percent_text(spark):
    assert spark.range(1).select(percent_text(F.lit(0.125)).alias("t")).first()["t"] == "12.5%"
