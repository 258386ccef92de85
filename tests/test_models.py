import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import explain, metrics, sampling, splits, tuning
from surveyloom.operators.classifiers import bayes, boosted_stumps, linear, neighbours, trees
from surveyloom.operators.spaces import FAMILIES, Choice, Family, Real, Whole, draw_params
from surveyloom.plans.cases import cases
from surveyloom.schema import FEATURES, KEY, LABEL


@pytest.fixture(scope="module")
def parts(spark):
    marked = splits.train_test_split(cases(spark, "/root/testdata/sf0.001"), KEY).cache()
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


def accuracy(model, test):
    return metrics.accuracy(model.predict(test), LABEL, "prediction").first()["accuracy"]


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly"])
def test_svm_kernels(parts, kernel):
    assert accuracy(linear.fit_svm(parts[0], FEATURES, LABEL, kernel=kernel, gamma=0.1, max_iter=20), parts[1]) > 0.8


def test_other_kernels_and_bad_draws_are_refused(parts):
    with pytest.raises(ValueError):
        linear.fit_svm(parts[0], FEATURES, LABEL, kernel="sigmoid")
    with pytest.raises(ValueError):
        trees.fit_forest(parts[0], FEATURES, LABEL, min_weight_fraction_leaf=0.8)
    with pytest.raises(ValueError):
        linear.fit_logistic(parts[0], FEATURES, LABEL, penalty="none")


def test_boosted_stumps_and_bayes(parts):
    assert accuracy(boosted_stumps.fit_adaboost(parts[0], FEATURES, LABEL, n_estimators=4), parts[1]) > 0.85
    assert accuracy(bayes.fit_bayes(parts[0], FEATURES, LABEL), parts[1]) > 0.85
    with pytest.raises(ValueError):
        bayes.fit_bayes(parts[0].where("label = 1"), FEATURES, LABEL)


def test_newton_steps_fit_the_same_line(parts):
    few = ["severity", "hard_access"]
    whole = parts[0].select(*few, LABEL)
    fitted = linear.fit_logistic(whole, few, LABEL).detail
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=few, outputCol="x").transform(whole)
    plain = LogisticRegression(featuresCol="x", labelCol=LABEL, regParam=1 / 1200, standardization=False, tol=1e-10, maxIter=300).fit(rows)
    assert np.allclose(fitted["coef"], plain.coefficients, rtol=1e-5) and fitted["intercept"] == pytest.approx(plain.intercept, rel=1e-5)


def brute(train, test, k, p, weights):
    x = np.array([[r[c] for c in FEATURES] for r in train], float)
    y = np.array([r[LABEL] for r in train])
    ids = np.array([r[KEY] for r in train])
    out = {}
    for r in test:
        diff = np.abs(x - np.array([r[c] for c in FEATURES], float))
        d = diff.sum(1) if p == 1 else np.sqrt((diff**2).sum(1))
        near = np.lexsort((ids, d))[:k]
        w = np.ones(len(near))
        if weights == "distance":
            w = (d[near] == 0).astype(float) if (d[near] == 0).any() else 1 / d[near]
        out[r[KEY]] = w[y[near] == 1].sum() / w.sum()
    return out


@pytest.mark.parametrize("k,p,weights", [(5, 2, "uniform"), (4, 1, "distance"), (5000, 2, "uniform")])
@pytest.mark.parametrize("block_rows", [20_000, 60])
def test_neighbours_equal_brute_force(parts, k, p, weights, block_rows):
    train, test = parts
    got = neighbours.knn_predict(train, test, FEATURES, KEY, LABEL, k, weights, p, block_rows=block_rows, chunk_rows=50)
    have = {r[KEY]: r["probability"] for r in got.collect()}
    want = brute(train.collect(), test.collect(), k, p, weights)
    assert have.keys() == want.keys()
    assert all(have[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_neighbours_of_a_hot_vector(spark):
    """A third of the rows are one vector; its copies may fill the places, but k of them are enough."""
    rows = [(i, [0.0, 0.0], 1) for i in range(200)] + [(200 + i, [float(i % 20 + 1), float(i // 20)], 0) for i in range(400)]
    train = spark.createDataFrame(rows, "id long, x array<double>, label int")
    query = spark.createDataFrame([(0, [0.1, 0.0], 1), (1, [19.0, 15.0], 0)], "id long, x array<double>, label int")
    got = {r["id"]: r["probability"] for r in neighbours.knn_predict(train, query, "x", "id", LABEL, 7, block_rows=50).collect()}
    assert got == {0: 1.0, 1: 0.0}


@pytest.mark.parametrize("fit", [trees.fit_boosting, trees.fit_forest, trees.fit_tree])
def test_shapley_values_add_up_to_the_score(parts, fit):
    options = {} if fit is trees.fit_tree else {"n_estimators": 5}
    train, test = parts
    model = fit(train, FEATURES, LABEL, **options)
    sums = explain.shapley_rows(model, test, train, KEY).groupBy(KEY).agg((F.first("base") + F.sum("contribution")).alias("s"))
    for r in sums.join(model.predict(test), KEY).collect():
        p = r["probability"]
        score = math.log(p / (1 - p)) / 2 if fit is trees.fit_boosting else p
        assert r["s"] == pytest.approx(score, abs=1e-9)


def test_shapley_values_equal_the_definition(parts):
    """All coalitions of three features against a small background."""
    few = ["severity", "hard_access", "district_code"]
    train, test = parts
    model = trees.fit_tree(train, few, LABEL, max_depth=4)
    back, rows = sampling.sample_n(train, KEY, 12), sampling.sample_n(test, KEY, 5)
    grid = [
        {"rid": r[KEY], "mask": m, **{c: (r if m >> i & 1 else b)[c] for i, c in enumerate(few)}}
        for r in rows.collect() for b in back.collect() for m in range(8)
    ]
    scored = model.predict(train.sparkSession.createDataFrame(grid))
    value = {(r["rid"], r["mask"]): r["v"] for r in scored.groupBy("rid", "mask").agg(F.avg("probability").alias("v")).collect()}
    for r in explain.shapley_rows(model, rows, back, KEY).collect():
        i = few.index(r["feature"])
        want = sum(
            math.factorial(m.bit_count()) * math.factorial(2 - m.bit_count()) / 6
            * (value[(r[KEY], m | 1 << i)] - value[(r[KEY], m)])
            for m in range(8) if not m >> i & 1
        )
        assert r["contribution"] == pytest.approx(want, abs=1e-9)


def test_split_counts_of_the_importance(parts):
    model = trees.fit_boosting(parts[0], FEATURES, LABEL, n_estimators=4)
    inner = explain.tree_nodes(model).where("left >= 0").count()
    assert explain.tree_importance(model, "dots").agg(F.sum("score")).first()[0] == inner
    assert explain.tree_importance(model, "Gain").first()["feature"] in ("severity", "hard_access")


def test_local_surrogate(parts):
    model = bayes.fit_bayes(parts[0], FEATURES, LABEL)
    rows = sampling.sample_n(parts[1], KEY, 3)
    got = explain.lime_explain(model, parts[0], rows, FEATURES, KEY, n_samples=500)
    one = got.orderBy(KEY, "place").collect()
    assert len(one) == 3 * len(FEATURES)
    assert all(abs(a["weight"]) >= abs(b["weight"]) for a, b in zip(one, one[1:]) if a[KEY] == b[KEY])
    assert {r["feature"] for r in one if r["place"] == 0} <= {"severity", "hard_access"}
    assert sorted(got.collect()) == sorted(got.collect())


def test_ablation_explains_both_variants_with_the_same_bins(parts, monkeypatch):
    train, test = parts
    rows = sampling.sample_n(test, KEY, 3)
    counted, quantiles = [], explain.grouped_quantiles

    def seen(long, *args, **more):
        counted.append(long.count())
        return quantiles(long, *args, **more)

    monkeypatch.setattr(explain, "grouped_quantiles", seen)
    task = tuning.Task(FEATURES, LABEL, KEY)
    got = tuning.ablation_report(train, test, rows, Family("Naive Bayes", bayes.fit_bayes, {}), {}, task, "severity", 300)
    assert counted == [sum(train.select(c).distinct().count() for c in FEATURES)]  # found once, and from counted values
    means = {(r["variant"], r["feature"]): r["mean_abs_weight"] for r in got.collect()}
    wanted = {}
    for variant, features in (("all features", FEATURES), ("without severity", [c for c in FEATURES if c != "severity"])):
        weights = explain.lime_explain(bayes.fit_bayes(train, features, LABEL), train, rows, features, KEY, 300)
        wanted |= {(variant, r["feature"]): r["m"] for r in weights.groupBy("feature").agg(F.avg(F.abs("weight")).alias("m")).collect()}
    assert means == pytest.approx(wanted)


def test_draws(parts):
    space = {"a": Choice((1, 2)), "b": Whole(1, 3)}
    assert len(draw_params(space, 100)) == 6
    assert draw_params(space, 4, 1) == draw_params(space, 4, 1)
    log = Real(1e-3, 1e2, log=True)
    assert all(1e-3 <= p["c"] <= 1e2 for p in draw_params({"c": log}, 50))


def test_search_and_comparison_record_failures(parts):
    train, test = parts
    bad = Family("Broken", trees.fit_forest, {"min_weight_fraction_leaf": Choice((0.8, 2.0))})
    good = Family("Naive Bayes", bayes.fit_bayes, {"var_smoothing": Real(1e-9, 1e-3, log=True)})
    task = tuning.Task(FEATURES, LABEL, KEY, folds=2, scoring="f1")
    results, models = tuning.compare_models(train, test, [bad, good], task, n_iter=2, rounds=2)
    rows = {r["model"]: r for r in results.collect()}
    assert rows["Broken"]["accuracy"] is None and "min_weight_fraction_leaf" in rows["Broken"]["error"]
    assert rows["Naive Bayes"]["accuracy"] > 0.85 and rows["Naive Bayes"]["error"] is None
    assert list(models) == ["Naive Bayes"]
    assert metrics.best_model(results).first()["model"] == "Naive Bayes"
    assert set(FAMILIES) >= {"SVM", "LDA", "AdaBoost", "XGBoost", "LightGBM"}
