"""Fits of many candidates together against single fits; boosting, extra trees and staged scores against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import metrics, splits, staged, tuning
from surveyloom.operators.classifiers import bayes, boosted_stumps, candidates, linear, newton, perceptron, random_trees, trees
from surveyloom.operators.spaces import FAMILIES, Choice, Family, Real, Whole, density_draws, draw_params
from surveyloom.plans.cases import cases
from surveyloom.schema import FEATURES, KEY, LABEL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    marked = splits.train_test_split(cases(spark, SF), KEY).cache()
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


def accuracy(model, test):
    return metrics.accuracy(model.predict(test), LABEL, "prediction").first()["accuracy"]


def scores(rows):
    return {(r[1], r[2]): r[3] for r in rows}


@pytest.mark.parametrize(
    "name,tried,scoring",
    [
        ("Naive Bayes", [{"var_smoothing": v} for v in (1e-9, 3.0)], "f1_weighted"),
        ("LDA", [{"shrinkage": v} for v in (0.0, 0.9)], "recall"),
        ("Logistic Regression", [{"C": 0.01, "penalty": "l1"}, {"C": 0.1, "penalty": "elasticnet", "fit_intercept": False}, {"penalty": None}], "f1"),
        ("AdaBoost", [{"n_estimators": 4, "learning_rate": 0.3}, {"n_estimators": 2, "learning_rate": 1.0}], "accuracy"),
    ],
)
def test_together_equals_one_by_one(parts, name, tried, scoring):
    family = FAMILIES[name]
    task = tuning.Task(FEATURES, LABEL, KEY, folds=2, scoring=scoring)
    folded = tuning.with_folds(parts[0], task)
    together = tuning.cross_validate(folded, family, tried, task)
    single = tuning.cross_validate(folded, Family(name, family.fit, family.space), tried, task)
    assert scores(together.rows) == pytest.approx(scores(single.rows), abs=1e-12)
    assert together.best == single.best and together.score == pytest.approx(single.score)
    folded.unpersist()


def test_bad_candidates_are_rows(parts):
    task = tuning.Task(FEATURES, LABEL, KEY, folds=2)
    folded = tuning.with_folds(parts[0], task)
    found = tuning.cross_validate(folded, FAMILIES["LDA"], [{"solver": "svd", "shrinkage": 0.5}, {"solver": "lsqr", "shrinkage": 0.5}], task)
    assert [r[5] is None for r in found.rows] == [False, False, True, True] and found.best["solver"] == "lsqr"
    found = tuning.cross_validate(folded, FAMILIES["Logistic Regression"], [{"penalty": "none"}, {"C": 0.5}], task)
    assert "unknown penalty" in found.rows[0][5] and found.best == {"C": 0.5}
    found = tuning.cross_validate(folded, FAMILIES["AdaBoost"], [{"n_estimators": 0}], task)
    assert found.best is None and "positive" in found.rows[0][5]


def test_moments_of_folds_are_those_of_their_rows(parts):
    folded = splits.stratified_kfold(parts[0], KEY, LABEL, 3).withColumn("far", F.col("severity") + 1e6)
    names = ["severity", "far", "hard_access"]
    by_fold = candidates.fold_moments(folded, names, LABEL)
    rows = folded.select("fold", LABEL, *names).toPandas()
    for held in (0, 1, 2, None):
        got = candidates.training_moments(by_fold, held)
        for k in (0, 1):
            x = rows[(rows.fold != held) & (rows[LABEL] == k)][names].to_numpy(float)
            assert got.rows[k] == len(x) and np.allclose(got.mean[k], x.mean(axis=0), rtol=1e-12)
            assert np.allclose(got.products[k], np.cov(x.T, bias=True) * len(x), rtol=1e-9)
    with pytest.raises(ValueError):
        candidates.training_moments(candidates.fold_moments(folded.where(f"{LABEL} = 1"), names, LABEL), 0)


def test_lasso_meets_its_conditions(parts):
    """At the optimum the slope of each zero weight is within the penalty, and that of the others equals it."""
    train = parts[0]
    p = newton.problem(C=0.02, penalty="l1")
    w = newton.solve(newton.counted_rows(train, FEATURES, LABEL), len(FEATURES), [p])[0]
    rows = train.select(*FEATURES, LABEL).toPandas()
    x, y = rows[FEATURES].to_numpy(float), rows[LABEL].to_numpy(float)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
    zero = w[:-1] == 0
    assert zero.any() and not zero.all()
    assert (np.abs(slope[zero]) <= p.lasso + 1e-6).all() and np.allclose(slope[~zero], -p.lasso * np.sign(w[:-1][~zero]), atol=1e-4)


def test_separable_rows_end(spark):
    df = spark.createDataFrame([(float(k), int(k > 5)) for k in range(12)], "a double, label int")
    model = linear.fit_logistic(df, ["a"], "label", penalty=None, max_iter=30)
    assert accuracy_of(model, df) == 1.0


def accuracy_of(model, df):
    return metrics.accuracy(model.predict(df), "label", "prediction").first()["accuracy"]


def test_newton_with_a_constant_feature(spark):
    df = spark.createDataFrame([(float(k % 7), 3.0, int(k % 7 + k % 3 > 4)) for k in range(100)], "a double, b double, label int")
    plain, more = linear.fit_logistic(df, ["a"], "label", penalty=None), linear.fit_logistic(df, ["a", "b"], "label", penalty=None)
    assert plain.detail["coef"][0] == pytest.approx(more.detail["coef"][0], rel=1e-6)


def plain_adaboost(x, y, rounds, rate):
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= t
                parts = [(w[left & (y == k)].sum(), w[~left & (y == k)].sum()) for k in (0, 1)]
                (ln, rn), (lp, rp) = parts
                cost = lp * ln / (lp + ln) + rp * rn / (rp + rn)
                if best is None or cost < best[0] * (1 - 1e-9):
                    best = cost, f, t, lp > ln, rp > rn
        _, f, t, l, r = best
        wrong = np.where(x[:, f] <= t, l, r) != y
        e = w[wrong].sum() / w.sum()
        if e >= 0.5:
            break
        alpha = rate * math.log((1 - e) / e)
        out.append((f, t, alpha))
        w = w * np.exp(alpha * wrong)
    return out


def test_boosting_equals_plain_code(parts):
    rows = parts[0].select(*FEATURES, LABEL).toPandas()
    wanted = plain_adaboost(rows[FEATURES].to_numpy(float), rows[LABEL].to_numpy(), 12, 0.7)
    model = boosted_stumps.fit_adaboost(parts[0].repartition(5), FEATURES, LABEL, n_estimators=12, learning_rate=0.7)
    assert model.detail["stumps"] == [(FEATURES[f], t) for f, t, _ in wanted]
    assert np.allclose(model.detail["alphas"], [a for _, _, a in wanted], rtol=1e-9)
    assert accuracy(model, parts[1]) > 0.85


def test_boosting_of_many_values_and_long_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), int(a + 0.3 * b > 0)) for a, b in rng.normal(0, 1, (3000, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label int").repartition(4)
    cuts = boosted_stumps.cut_points(df, ["a", "b"], 64)
    assert [len(c) for c in cuts] == [63, 63]
    short, long = (boosted_stumps.fit_adaboost(df, ["a", "b"], "label", n_estimators=n, places=64) for n in (3, 25))
    assert accuracy_of(long, df) > max(0.95, accuracy_of(short, df))
    plan = long.predict(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(long.detail["alphas"]) == 25 and plan.count("CASE WHEN") < 140


def test_a_perfect_stump_ends_the_rounds(spark):
    df = spark.createDataFrame([(float(k), 0.0, int(k > 5)) for k in range(12)], "a double, b double, label int")
    model = boosted_stumps.fit_adaboost(df, ["a", "b"], "label", n_estimators=50)
    assert len(model.detail["alphas"]) == 1 and accuracy_of(model, df) == 1.0
    with pytest.raises(ValueError):
        boosted_stumps.fit_adaboost(df.select("b", (F.col("a") % 2).cast("int").alias("label")), ["b"], "label", n_estimators=3)


def test_extra_trees_do_not_depend_on_the_layout(parts):
    train, test = parts
    options = {"n_estimators": 12, "max_depth": 5, "min_samples_leaf": 2, "seed": 5}
    one, many = (random_trees.fit_extra_trees(train.repartition(k), FEATURES, LABEL, **options) for k in (1, 7))
    for field in ("feature", "threshold", "left", "right", "counts"):
        assert np.array_equal(getattr(one.nodes, field), getattr(many.nodes, field))
    assert accuracy(one, test) > 0.8
    other = random_trees.fit_extra_trees(train, FEATURES, LABEL, **{**options, "seed": 6})
    assert not np.array_equal(one.nodes.threshold[:12], other.nodes.threshold[:12])


def test_extra_trees_follow_their_rules(parts):
    train, test = parts
    model = random_trees.fit_extra_trees(train, FEATURES, LABEL, n_estimators=8, max_depth=5, min_samples_leaf=7, min_samples_split=30)
    nodes, rows = model.nodes, train.select(*FEATURES, LABEL).toPandas()
    x, y = rows[FEATURES].to_numpy(float), rows[LABEL].to_numpy()
    at = nodes.route(x, np.arange(8))
    for t in range(8):
        counts = np.zeros_like(nodes.counts)
        np.add.at(counts, (at[t], y), 1)
        leaves = np.unique(at[t])
        assert np.array_equal(counts[leaves], nodes.counts[leaves])  # a leaf's counts are those of the rows it gets
        assert (nodes.counts[leaves].sum(axis=1) >= 7).all()
    inner = nodes.feature >= 0
    assert (nodes.counts[inner].sum(axis=1) >= 30).all() and (nodes.heap < 2**6).all()
    drawn = nodes.threshold[inner & (np.array(FEATURES)[np.maximum(nodes.feature, 0)] == "hard_access")]
    assert len(drawn) > 5 and len(np.unique(drawn)) == len(drawn) and (drawn > 0).all() and (drawn < 1).all()  # not only at the middle
    share = nodes.counts[:, 1] / nodes.counts.sum(axis=1)
    probability = {r[KEY]: r["probability"] for r in model.predict(test).collect()}
    few = test.limit(20).collect()
    for r in few:
        v = np.array([[r[c] for c in FEATURES]], float)
        assert probability[r[KEY]] == pytest.approx(share[nodes.route(v, np.arange(8))].mean())


def test_extra_trees_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1)] * 9, "a double, b double, label int")
    model = random_trees.fit_extra_trees(df, ["a", "b"], "label", n_estimators=3)
    assert {r["probability"] for r in model.predict(df).collect()} == {1.0}
    with pytest.raises(ValueError):
        random_trees.fit_extra_trees(df.where("false"), ["a", "b"], "label", n_estimators=3)
    with pytest.raises(ValueError):
        random_trees.fit_extra_trees(df, ["a", "b"], "label", max_features="some")


def test_staged_scores_are_those_of_shorter_models(parts):
    train, test = parts
    longer = staged.pack(trees.fit_boosting(train, FEATURES, LABEL, n_estimators=12))
    rows = longer.staged_margins(test).collect()
    assert all(len(r["margins"]) == 12 for r in rows)
    for n in (1, 5, 12):
        spark_model = trees.fit_boosting(train, FEATURES, LABEL, n_estimators=n)
        wanted = {r[KEY]: (r["prediction"], r["probability"]) for r in spark_model.predict(test).collect()}
        got = {r[KEY]: (r["prediction"], r["probability"]) for r in longer.prefix(n).predict(test).collect()}
        assert got.keys() == wanted.keys()
        for k in got:
            assert got[k][0] == wanted[k][0] and got[k][1] == pytest.approx(wanted[k][1], abs=1e-9)
        for r in rows:
            assert 1 / (1 + math.exp(-2 * r["margins"][n - 1])) == pytest.approx(wanted[r[KEY]][1], abs=1e-9)
    aucs = {r["trees"]: r["auc"] for r in staged.staged_auc(longer.staged_margins(test), LABEL).collect()}
    for n in (1, 7, 12):
        one = metrics.roc_auc(longer.prefix(n).predict(test), LABEL, "probability").first()["auc"]
        assert aucs[n] == pytest.approx(one, abs=1e-12)


def test_patience():
    assert staged.best_prefix([0.5, 0.7, 0.7, 0.6, 0.9], 2) == (2, True)
    assert staged.best_prefix([0.5, 0.7, 0.7, 0.6, 0.9], 3) == (5, False)
    assert staged.best_prefix([0.5], 3) == (1, False)


def test_early_stop_takes_the_best_prefix(parts):
    train, val = parts
    model, looked = staged.fit_boosting_early_stop(train, val, FEATURES, LABEL, n_estimators=40, patience=8)
    aucs = [r["auc"] for r in looked.orderBy("trees").collect()]
    assert model.trees == staged.best_prefix(aucs, 8)[0] and len(aucs) <= 40
    assert aucs[model.trees - 1] == max(aucs[: model.trees + 8])


def test_density_draws_beat_even_ones():
    """A planted score over eight dimensions: later rounds find better points than as many even draws."""
    space = {**{f"x{k}": Real(0.0, 1.0) for k in range(4)}, "c": Choice(("a", "b", "c")), "n": Whole(1, 40), "g": Real(1e-4, 1e2, log=True), "f": Choice((True, False))}

    def score(p):
        return -sum((p[f"x{k}"] - 0.7) ** 2 for k in range(4)) - abs(p["n"] - 31) / 40 - abs(math.log10(p["g"]) - 1) / 6 + 0.3 * (p["c"] == "b") + 0.2 * p["f"]

    wins = 0
    for seed in range(10):
        tried = []
        for r in range(8):
            tried += [(p, score(p)) for p in density_draws(space, tried, 10, 100 * seed + r)]
        assert len(tried) == 80 and len({repr(sorted(p.items())) for p, _ in tried}) == 80
        assert all(1 <= p["n"] <= 40 and 1e-4 <= p["g"] <= 1e2 for p, _ in tried)
        wins += max(s for _, s in tried) > max(score(p) for p in draw_params(space, 80, 1000 + seed))
    assert wins >= 9
    assert len(density_draws({"c": Choice((1, 2))}, [({"c": 1}, 0.5)], 5)) <= 5


def test_space_search_uses_all_trials(parts):
    task = tuning.Task(FEATURES, LABEL, KEY, folds=2)
    folded = tuning.with_folds(parts[0], task)
    family = Family("Naive Bayes", bayes.fit_bayes, {"var_smoothing": Real(1e-9, 1e1, log=True)}, many=FAMILIES["Naive Bayes"].many)
    found = tuning.space_search(folded, family, task, 21, rounds=5)
    assert len(found.rows) == 42 and found.score == max(found.means.values())


def test_best_parameters_are_reported(parts):
    train, test = parts
    task = tuning.Task(FEATURES, LABEL, KEY)
    out = tuning.report_best(train, test, FAMILIES["LDA"], {"shrinkage": 0.2}, task)
    assert [tuple(r) for r in out["params"].collect()] == [("LDA", "shrinkage", "0.2")]
    assert {r["class_name"] for r in out["report"].collect()} == {"0", "1", "macro avg", "weighted avg"}
    assert sum(r["n"] for r in out["confusion"].collect()) == test.count()


@pytest.mark.parametrize("activation", ["relu", "tanh", "logistic"])
def test_slopes_equal_differences(activation):
    rng = np.random.default_rng(3)
    shape = perceptron.Shape((4, 6, 5, 1), activation)
    x, y, n = rng.normal(0, 1, (30, 4)), rng.integers(0, 2, 30).astype(float), rng.integers(1, 4, 30).astype(float)
    flat = shape.start(2)
    _, slope = shape.loss_and_slope(flat, x, y, n)
    for k in range(0, shape.length, 3):
        step = np.zeros(shape.length)
        step[k] = 1e-6
        up, down = (shape.loss_and_slope(flat + s * step, x, y, n)[0] for s in (1, -1))
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.mark.parametrize("schedule", ["constant", "adaptive"])
def test_perceptron_learns_what_no_line_can(spark, schedule):
    rows = [(a, b, int((a > 0) != (b > 0))) for a in (-2.0, -1.0, 1.0, 2.0) for b in (-2.0, -1.0, 1.0, 2.0)] * 3
    df = spark.createDataFrame(rows, "a double, b double, label int").repartition(3)
    model = perceptron.fit_perceptron(df, ["a", "b"], "label", hidden=(16,), activation="tanh", learning_rate=0.1, schedule=schedule, max_iter=60)
    assert accuracy_of(model, df) == 1.0 and model.losses[-1] < 0.3 * model.losses[0]
    with pytest.raises(ValueError):
        perceptron.fit_perceptron(df, ["a", "b"], "label", activation="step")


@pytest.mark.parametrize("kernel,gamma", [("rbf", 0.1), ("rbf", 1.0), ("poly", 0.3)])
def test_kernel_features_approach_the_kernel(parts, kernel, gamma):
    few, many = (linear.fit_svm(parts[0], FEATURES, LABEL, kernel=kernel, gamma=gamma, landmarks=n, max_iter=5) for n in (30, 400))
    assert few.detail["pairs"] >= 9000 and many.detail["rms_error"] < few.detail["rms_error"] + 1e-9
    rows = np.random.default_rng(1).normal(0, 1, (5, len(FEATURES)))
    on = linear.KernelModel(FEATURES, many.scaler, kernel, gamma, rows)
    assert np.allclose(on.map(rows) @ on.map(rows).T, linear.KERNELS[kernel](rows, rows, gamma), atol=1e-8)  # exact on the landmarks
    if gamma == 0.1:
        assert many.detail["rms_error"] < 0.02
