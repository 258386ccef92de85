"""One entry per operator: the Spark query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.scalars import label_name
from surveyloom.operators import encoding, explain, metrics, profile, rank, sampling, series, splits, tuning
from surveyloom.operators import staged
from surveyloom.operators.classifiers import bayes, boosted_stumps, linear, neighbours, perceptron, random_trees, trees
from surveyloom.operators.classifiers.candidates import bayes_margin, from_moments
from surveyloom.operators.spaces import FAMILIES, Choice, Family, Real
from surveyloom.plans.cases import cases, digits, gapped_cases, table
from surveyloom.schema import CASE_SCHEMA, CATEGORIES, FEATURES, KEY, LABEL
from surveyloom.session import fresh_path, materialize
from surveyloom.sources import files, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
SCALED = ["severity", "hard_access", "district_code"]
LINEAR_SCORE = {"severity": 2.0, "hard_access": 3.0, "gender": 0.5, "diet": -0.25}
RULES = {"severity>=3": 3, "severity>=4": 4, "severity>=5": 5}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with a fixed rule's prediction and score, so that metrics can be checked without a model."""
    score = (2 * F.col("severity") + 3 * F.col("hard_access") + F.lit(1.0)) / F.lit(16.0)
    return cases(spark, sf).withColumns({"prediction": (F.col("severity") >= 4).cast("int"), "score": score})


def split_cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; the marked table is written once, as every learner reads it many times."""
    marked = materialize(splits.train_test_split(cases(spark, sf), KEY), "cases")
    return marked.where(F.col("split") == "train").drop("split"), marked.where(F.col("split") == "test").drop("split")


# ---------------------------------------------------------------- sources and sinks


@query
def load_cases(spark, sf):
    path = fresh_path(spark, "cases.csv")
    cases(spark, sf).write.option("header", True).csv(path)
    return files.load_table(spark, path, CASE_SCHEMA, "csv")


@query
def canonical_rename(spark, sf):
    orders = table(spark, sf, "orders")
    return files.canonical_rename(orders, ["row_key", "owner", "state", "amount", "day", "urgency"])


@query
def table_replace(spark, sf):
    path = fresh_path(spark, "raw")
    name = "surveyloom_raw_data"
    tables.replace_table(cases(spark, sf).drop("case_id", "district_code"), name, path)
    stored = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    return stored


@query
def append_distinct(spark, sf):
    path = fresh_path(spark, "distinct")
    name = "surveyloom_answers"
    answers = cases(spark, sf).select("district_name", "severity", "label")
    tables.create_table(answers.limit(0), name, path)
    tables.append_distinct(answers, name)
    stored = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return stored


@query
def list_tables(spark, sf):
    for name in GIVEN:
        table(spark, sf, name).createOrReplaceTempView(name)
    listed = [n for n in tables.list_tables(spark) if n in GIVEN]
    shapes = [sampling.shape(spark.table(n)).select(F.lit(n).alias("table_name"), "*") for n in listed]
    return profile.union_by_name(shapes)


@query
def list_base_tables(spark, sf):
    made = cases(spark, sf)
    stored = {
        "surveyloom_rows": made,
        "surveyloom_counts": profile.group_count(made, ["district_name", "label"]),
    }
    paths = {n: fresh_path(spark, n) for n in stored}
    for n, df in stored.items():
        tables.replace_table(df, n, paths[n])
    made.createOrReplaceTempView("surveyloom_view")
    try:
        listed = [n for n in tables.list_base_tables(spark) if n in stored or n == "surveyloom_view"]
    finally:
        spark.catalog.dropTempView("surveyloom_view")
        for n in stored:
            spark.sql(f"DROP TABLE {n}")
    shapes = [sampling.shape(spark.read.parquet(paths[n])).select(F.lit(n).alias("table_name"), "*") for n in listed]
    return profile.union_by_name(shapes)


# ---------------------------------------------------------------- projections and rows


@query
def drop_columns(spark, sf):
    return cases(spark, sf).drop("case_id", "district_code")


@query
def numeric_columns(spark, sf):
    return profile.numeric_columns(cases(spark, sf))


@query
def head_n(spark, sf):
    return sampling.head_n(cases(spark, sf), KEY, 5)


@query
def sample_n(spark, sf):
    return sampling.sample_n(cases(spark, sf), KEY, 50, seed=3)


@query
def sample_range(spark, sf):
    picked = sampling.sample_range(cases(spark, sf), KEY, 10, 1000, 30)
    return picked.select("position", KEY, "severity", LABEL)


@query
def rows_by_key(spark, sf):
    df = cases(spark, sf)
    return sampling.rows_by_key(df, sampling.sample_n(df.select(KEY), KEY, 40, seed=5), KEY)


@query
def shape(spark, sf):
    return sampling.shape(cases(spark, sf))


@query
def column_info(spark, sf):
    return profile.column_info(gapped_cases(spark, sf))


@query
def label_names(spark, sf):
    named = label_name(F.col(LABEL), {0: "not affected", 1: "affected"})
    return cases(spark, sf).select(KEY, named.alias("label_name"))


@query
def forecast_band(spark, sf):
    price = F.col("o_totalprice")
    bands = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ds"), price.alias("close"), (price * 0.5).alias("forecast"),
        (price * 0.75).alias("hi"), (price * 0.25).alias("lo"),
    )
    return series.forecast_band(bands, "o_orderkey", "ds", "close", "forecast", "hi", "lo")


@query
def align_xy(spark, sf):
    df = cases(spark, sf)
    return sampling.align_by_key(df.select(KEY, *FEATURES), df.select(KEY, LABEL), KEY)


# ---------------------------------------------------------------- profile


@query
def describe_numeric(spark, sf):
    out = profile.describe_numeric(table(spark, sf, "lineitem"))
    return rounded(out, "mean", "std", "min", "q25", "q50", "q75", "max", digits=4)


@query
def describe_cases(spark, sf):
    out = profile.describe_numeric(gapped_cases(spark, sf), [*FEATURES, LABEL])
    return rounded(out, "mean", "std", "min", "q25", "q50", "q75", "max")


@query
def null_report(spark, sf):
    return rounded(profile.null_report(gapped_cases(spark, sf)), "pct_null")


@query
def group_count(spark, sf):
    return profile.group_count(gapped_cases(spark, sf), ["district_name", "severity"])


@query
def value_share(spark, sf):
    return rounded(profile.value_share(gapped_cases(spark, sf), "severity"), "share")


@query
def count_share_all(spark, sf):
    return rounded(profile.count_share_all(gapped_cases(spark, sf), "severity"), "share")


@query
def class_value_share(spark, sf):
    return rounded(profile.class_value_share(gapped_cases(spark, sf), CATEGORIES, LABEL), "share")


@query
def feature_label_counts(spark, sf):
    return profile.feature_label_counts(gapped_cases(spark, sf), CATEGORIES, LABEL)


@query
def crosstab(spark, sf):
    return profile.crosstab(cases(spark, sf), "district_name", LABEL, {0: "negative", 1: "positive"})


@query
def spearman_matrix(spark, sf):
    return rounded(profile.spearman_matrix(cases(spark, sf), [*FEATURES, LABEL]), "rho")


@query
def spearman_continuous(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(profile.spearman_matrix(table(spark, sf, "lineitem"), cols), "rho")


@query
def high_corr_pairs(spark, sf):
    return rounded(profile.high_corr_pairs(cases(spark, sf), [*FEATURES, LABEL], 0.5), "rho")


@query
def bucket_rank(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rank.bucket_rank(orders, "o_totalprice", "o_orderstatus")


@query
def parse_series(spark, sf):
    k = F.col("o_orderkey")
    broken = digits(k, "date") % 19 == 0
    parts = []
    for unit, layout in (("day", "yyyy-MM-dd"), ("month", "yyyy-MM"), ("year", "yyyy")):
        text = F.when(broken, F.lit("2024-02-30x")).otherwise(F.date_format("o_orderdate", layout))
        dated = table(spark, sf, "orders").select(k, text.alias("ds"), "o_totalprice")
        out = series.dated_series(dated, "o_orderkey", "ds", "o_totalprice", unit)
        parts.append(out.withColumn("unit", F.lit(unit)))
    return profile.union_by_name(parts)


@query
def factorize(spark, sf):
    events = table(spark, sf, "events")
    gap = F.when(F.col("event_id") % 7 != 3, F.col("event_type"))
    return encoding.factorize(events.select("event_id", gap.alias("event_type")), "event_type", "event_id")


@query
def district_dim(spark, sf):
    return encoding.dimension_table(cases(spark, sf), "district_name", KEY)


@query
def standardize(spark, sf):
    df = cases(spark, sf).select(KEY, *SCALED)
    return rounded(encoding.standardize(df, SCALED), *SCALED)


# ---------------------------------------------------------------- metrics


@query
def accuracy(spark, sf):
    return rounded(metrics.accuracy(judged(spark, sf), LABEL, "prediction"), "accuracy")


@query
def binary_metrics(spark, sf):
    out = metrics.binary_metrics(judged(spark, sf), LABEL, "prediction", ["district_name"])
    return rounded(out, "accuracy", "precision", "recall", "f1", "f1_weighted")


@query
def class_report(spark, sf):
    names = {0: "not affected", 1: "affected"}
    out = metrics.class_report(judged(spark, sf), LABEL, "prediction", names, totals=True)
    return rounded(out, "precision", "recall", "f1")


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(judged(spark, sf), LABEL, "prediction")


@query
def f1_weighted(spark, sf):
    return rounded(metrics.f1_weighted(judged(spark, sf), LABEL, "prediction"), "f1_weighted")


@query
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(judged(spark, sf), LABEL, "score"), "auc")


@query
def log_loss(spark, sf):
    return rounded(metrics.log_loss(judged(spark, sf), LABEL, "score"), "log_loss")


def _rule(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    guess: Column = (F.col("severity") >= RULES[name]).cast("int")
    out = metrics.binary_metrics(df.withColumn("guess", guess), LABEL, "guess", by or [])
    return out.withColumn("model", F.lit(name))


@query
def cv_summary(spark, sf):
    folded = splits.stratified_kfold(cases(spark, sf), KEY, LABEL, 5)
    trials = profile.union_by_name([_rule(folded, r, ["fold"]) for r in RULES])
    return metrics.cv_summary(trials, ["model"], "accuracy")


@query
def best_model(spark, sf):
    results = profile.union_by_name([_rule(cases(spark, sf), r) for r in RULES])
    return rounded(metrics.best_model(results), "accuracy", "precision", "recall", "f1", "f1_weighted")


@query
def union_metrics(spark, sf):
    first, second = (_rule(cases(spark, sf), r).select("model", "accuracy", "f1") for r in list(RULES)[:2])
    return rounded(profile.union_by_name([first, second.drop("f1")]), "accuracy", "f1")


# ---------------------------------------------------------------- splits


@query
def train_test_split(spark, sf):
    return splits.train_test_split(cases(spark, sf), KEY).select(KEY, LABEL, "split")


@query
def stratified_split(spark, sf):
    return splits.stratified_split(cases(spark, sf), KEY, LABEL).select(KEY, LABEL, "split")


@query
def three_way_split(spark, sf):
    return splits.three_way_split(cases(spark, sf), KEY).select(KEY, LABEL, "split")


@query
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(cases(spark, sf), KEY, LABEL, 5).select(KEY, LABEL, "fold")


@query
def split_counts(spark, sf):
    return rounded(splits.split_counts(splits.three_way_split(cases(spark, sf), KEY)), "share")


# ---------------------------------------------------------------- classifiers


def _scored(model, test: DataFrame) -> DataFrame:
    return model.predict(test).select(KEY, LABEL, "prediction", "probability")


@query
def gaussian_nb(spark, sf):
    train, test = split_cases(spark, sf)
    out = bayes.fit_bayes(train, FEATURES, LABEL).predict(test)
    return rounded(out.select(KEY, LABEL, "prediction", "probability"), "probability")


@query
def lda_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return rounded(_scored(linear.fit_discriminant(train, FEATURES, LABEL, shrinkage=0.1), test), "probability")


@query
def logreg_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return rounded(_scored(linear.fit_logistic(train, FEATURES, LABEL, C=1.0), test), "probability")


@query
def svm_fit(spark, sf):
    train, test = split_cases(spark, sf)
    parts = [
        _scored(linear.fit_svm(train, FEATURES, LABEL, kernel=k, gamma=0.1), test).withColumn("kernel", F.lit(k))
        for k in ("linear", "rbf", "poly")
    ]
    return profile.union_by_name(parts)


@query
def mlp_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return _scored(perceptron.fit_perceptron(train, FEATURES, LABEL, hidden=(100, 50)), test)


@query
def gbt_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return _scored(trees.fit_boosting(train, FEATURES, LABEL), test)


@query
def rf_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return _scored(trees.fit_forest(train, FEATURES, LABEL), test)


@query
def extra_trees_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return _scored(random_trees.fit_extra_trees(train, FEATURES, LABEL, max_depth=10), test)


@query
def dt_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return rounded(_scored(trees.fit_tree(train, FEATURES, LABEL), test), "probability")


@query
def adaboost_fit(spark, sf):
    train, test = split_cases(spark, sf)
    return _scored(boosted_stumps.fit_adaboost(train, FEATURES, LABEL, n_estimators=199, learning_rate=0.3), test)


@query
def adaboost_rounds(spark, sf):
    """The stumps of the first rounds, which SQL can repeat."""
    train, _ = split_cases(spark, sf)
    found = boosted_stumps.fit_adaboost(train, FEATURES, LABEL, n_estimators=5, learning_rate=0.3).detail
    rows = [(k + 1, f, t, a) for k, ((f, t), a) in enumerate(zip(found["stumps"], found["alphas"], strict=True))]
    return rounded(spark.createDataFrame(rows, "round int, feature string, threshold double, alpha double"), "alpha")


@query
def knn_predict(spark, sf):
    marked = splits.train_test_split(table(spark, sf, "embeddings"), "vec_id")
    train, test = marked.where(F.col("split") == "train"), marked.where(F.col("split") == "test")
    out = neighbours.knn_predict(train, test, "embedding", "vec_id", LABEL, k=5)
    return out.select("vec_id", LABEL, "prediction")


@query
def knn_cases(spark, sf):
    train, test = split_cases(spark, sf)
    out = neighbours.knn_predict(train, test, FEATURES, KEY, LABEL, k=7, p=1)
    return rounded(out.select(KEY, LABEL, "prediction", "probability"), "probability")


# ---------------------------------------------------------------- tuning


def _task(**changes) -> tuning.Task:
    return tuning.Task(FEATURES, LABEL, KEY, **changes)


def _searched(spark, sf, search, **changes) -> DataFrame:
    train, _ = split_cases(spark, sf)
    task = _task(**changes)
    folded = tuning.with_folds(train, task)
    try:
        return search(folded, task).trials
    finally:
        folded.unpersist()


@query
def cv_score(spark, sf):
    one = [{"var_smoothing": 1e-9}]
    trials = _searched(spark, sf, lambda f, task: tuning.cross_validate(f, FAMILIES["Naive Bayes"], one, task))
    return metrics.cv_summary(trials, ["model"])


# Wide enough for the trials to differ.
SMOOTHING = {"var_smoothing": Real(1e-9, 1e1, log=True)}
DRAWS = 100


@query
def best_trial(spark, sf):
    family = Family("Naive Bayes", bayes.fit_bayes, SMOOTHING, many=from_moments(bayes_margin))
    trials = _searched(spark, sf, lambda f, task: tuning.random_search(f, family, task, DRAWS))
    best = tuning.best_trial(trials)
    smoothing = F.col("params")["var_smoothing"].cast("double")
    return rounded(best.select("model", "trial", "score", smoothing.alias("var_smoothing")), "score", "var_smoothing")


SHRINKING = {"shrinkage": Real(0.0, 1.0)}


@query
def tune_random(spark, sf):
    families = [
        Family("Naive Bayes", bayes.fit_bayes, SMOOTHING, many=FAMILIES["Naive Bayes"].many),
        Family("LDA", linear.fit_discriminant, SHRINKING, many=FAMILIES["LDA"].many),
    ]
    parts = [_searched(spark, sf, lambda f, task, own=own: tuning.random_search(f, own, task, DRAWS), scoring="f1") for own in families]
    return rounded(profile.union_by_name(parts).select("model", "trial", "fold", "score"), "score")


@query
def tune_logistic(spark, sf):
    return _searched(spark, sf, lambda f, task: tuning.random_search(f, FAMILIES["Logistic Regression"], task, DRAWS), scoring="f1")


@query
def tune_space(spark, sf):
    return _searched(spark, sf, lambda f, task: tuning.space_search(f, FAMILIES["Logistic Regression"], task, 80))


COMPARED = ("Naive Bayes", "LDA", "Logistic Regression", "AdaBoost")


def _compared(spark, sf):
    marked = materialize(splits.stratified_split(cases(spark, sf), KEY, LABEL), "cases")
    train, test = (marked.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    task = _task(scoring="accuracy")
    return train, test, task, tuning.compare_models(train, test, [FAMILIES[n] for n in COMPARED], task, n_iter=20)[0]


@query
def compare_models(spark, sf):
    return _compared(spark, sf)[3]


@query
def best_report(spark, sf):
    train, test = split_cases(spark, sf)
    task = _task()
    folded = tuning.with_folds(train, task)
    try:
        family = Family("LDA", linear.fit_discriminant, SHRINKING, many=FAMILIES["LDA"].many)
        found = tuning.random_search(folded, family, task, DRAWS)
    finally:
        folded.unpersist()
    out = tuning.report_best(train, test, family, found.best, task)
    cells = out["confusion"].select(
        F.concat(F.lit("actual "), F.col("actual"), F.lit(", predicted "), F.col("predicted")).alias("class_name"), F.col("n").alias("support")
    )
    return rounded(profile.union_by_name([out["report"], cells]), "precision", "recall", "f1")


@query
def gbt_early_stop(spark, sf):
    marked = materialize(splits.three_way_split(cases(spark, sf), KEY), "cases")
    train, val, test = (marked.where(F.col("split") == part).drop("split") for part in ("train", "val", "test"))
    model, _ = staged.fit_boosting_early_stop(train, val, FEATURES, LABEL)
    return _scored(model, test).withColumn("n_trees", F.lit(model.trees))


# ---------------------------------------------------------------- explanations


def _boosted(spark, sf):
    train, test = split_cases(spark, sf)
    return trees.fit_boosting(train, FEATURES, LABEL, n_estimators=100), train, test


@query
def tree_importance(spark, sf):
    model, _, _ = _boosted(spark, sf)
    parts = [explain.tree_importance(model, k).withColumn("kind", F.lit(k)) for k in ("gain", "cover", "weight")]
    return profile.union_by_name(parts)


@query
def lime_explain(spark, sf):
    model, train, test = _boosted(spark, sf)
    return explain.lime_explain(model, train, sampling.sample_n(test, KEY, 30, seed=2), FEATURES, KEY)


@query
def ablation_report(spark, sf):
    train, test = split_cases(spark, sf)
    rows = sampling.sample_n(test, KEY, 30, seed=2)
    return tuning.ablation_report(train, test, rows, FAMILIES["Gradient Boosting"], {"n_estimators": 100}, _task(), "severity")


@query
def shapley_rows(spark, sf):
    model, train, test = _boosted(spark, sf)
    return explain.shapley_rows(model, test, train, KEY)


def _linear_contributions(spark, sf) -> tuple[DataFrame, DataFrame]:
    train, test = split_cases(spark, sf)
    return explain.shapley_linear(test, train, LINEAR_SCORE, -10.0, KEY), test


@query
def shapley_linear(spark, sf):
    out, _ = _linear_contributions(spark, sf)
    return rounded(out, "contribution", "base")


@query
def shapley_summary(spark, sf):
    out, _ = _linear_contributions(spark, sf)
    summary = explain.shapley_summary(out)
    return rounded(summary, *[c for c in summary.columns if c != "feature"])


@query
def force_rows(spark, sf):
    out, test = _linear_contributions(spark, sf)
    picked = explain.force_rows(out, sampling.sample_n(test, KEY, 30, seed=2), KEY)
    return rounded(picked, "contribution", "base", "score")


@query
def dependence(spark, sf):
    out, _ = _linear_contributions(spark, sf)
    return rounded(explain.dependence(out), "contribution")
