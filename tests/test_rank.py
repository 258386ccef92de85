import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import profile, rank, splits

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def values(spark):
    """Two groups; a third of the rows share one value."""
    n = 3000
    x = np.round(RNG.lognormal(0, 2, n), 3)
    x[: n // 3] = 1.5
    pdf = pd.DataFrame({"k": np.arange(n), "g": RNG.choice(["a", "b"], n), "x": x})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_average_rank_equals_pandas(values):
    pdf, df = values
    got = rank.bucket_rank(df, "x", "g").toPandas().sort_values("k")
    want = pdf.groupby("g")["x"].rank()
    assert np.allclose(got["avg_rank"].to_numpy(), want.to_numpy())


def test_running_sums_with_negative_and_infinite_values(spark):
    v = [float("-inf"), -3.5, 0.0, 2.0, 1e300, float("inf")]
    df = spark.createDataFrame([(x, 1) for x in v], "v double, n long")
    rows = sorted((r["v"], r["n_before"]) for r in rank.prefix_sums(df, "v", ["n"]).collect())
    assert rows == list(zip(sorted(v), range(6)))


def test_running_sums_of_texts_per_group(spark):
    df = spark.createDataFrame([(g, t, 2) for g in (True, False) for t in "bdac"], "g boolean, t string, n long")
    rows = {(r["g"], r["t"]): r["n_before"] for r in rank.prefix_sums(df, "t", ["n"], "g").collect()}
    assert rows == {(g, t): 2 * k for g in (True, False) for k, t in enumerate("abcd")}


def test_an_outlier_does_not_empty_the_other_ranges(spark):
    df = spark.range(200_000).selectExpr("id as v", "1L as n").union(spark.sql("select 9000000000000000000, 1L"))
    stored = rank.prefix_sums(df, "v", ["n"])
    sizes = df.repartitionByRange(8, "v").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.avg("count")).first()
    assert sizes[0] < 2 * sizes[1]
    assert stored.where("n_before != case when v > 1e9 then 200000 else v end").count() == 0


def test_quantiles_equal_numpy(values):
    pdf, df = values
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = profile.grouped_quantiles(df, probs, "g", "x").collect()
    assert len(got) == 2 * len(probs)
    for r in got:
        want = np.quantile(pdf.loc[pdf.g == r["g"], "x"], r["prob"])
        assert r["quantile"] == pytest.approx(want, rel=1e-12)


def test_spearman_with_ties_and_a_constant(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 2, 4, 5, 6], "b": [2.0, 1, 4, 4, 6, 5], "c": [7.0] * 6})
    got = {(r[0], r[1]): r[2] for r in profile.spearman_matrix(spark.createDataFrame(pdf)).collect()}
    assert got[("a", "b")] == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))
    assert got[("b", "a")] == got[("a", "b")]
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert len(got) == 9


def test_cuts_give_exact_sizes_and_do_not_depend_on_partitions(spark):
    df = spark.range(607).withColumnRenamed("id", "k")
    one = splits.train_test_split(df.repartition(1), "k").where("split = 'test'")
    many = splits.train_test_split(df.repartition(13), "k").where("split = 'test'")
    assert one.count() == 122
    assert sorted(one.collect()) == sorted(many.collect())
    other = splits.train_test_split(df, "k", seed=2).where("split = 'test'")
    assert sorted(other.collect()) != sorted(one.collect())


def test_equal_keys_cannot_be_cut(spark):
    df = spark.createDataFrame([(1,)] * 10, "k long")
    with pytest.raises(ValueError, match="not unique"):
        splits.train_test_split(df, "k")


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "k long, label int")
    assert splits.train_test_split(df, "k").count() == 0
    assert splits.stratified_split(df, "k", "label").count() == 0
    assert splits.stratified_kfold(df, "k", "label").count() == 0


def test_quotas_and_folds_keep_the_classes(spark):
    df = spark.range(103).selectExpr("id as k", "cast(id % 10 = 0 as int) as label")
    parts = {(r["split"], r["label"]): r["count"] for r in splits.stratified_split(df, "k", "label").groupBy("split", "label").count().collect()}
    assert parts == {("test", 0): 19, ("test", 1): 2, ("train", 0): 73, ("train", 1): 9}
    folds = splits.stratified_kfold(df, "k", "label", 3).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_folds_of_a_boolean_label(spark):
    df = spark.range(9_000).selectExpr("id as k", "id % 3 = 0 as label")
    sizes = splits.stratified_kfold(df, "k", "label", 4).groupBy("label", "fold").count().collect()
    assert len(sizes) == 8 and {r["count"] for r in sizes} <= {1500, 750}
