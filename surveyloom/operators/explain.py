"""Explaining a fitted model: tree importance, local surrogates, Shapley contributions and their summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.hashing import uniform
from surveyloom.operators.classifiers.base import PipelineClassifier
from surveyloom.operators.classifiers.boosted_trees import BoostedTrees
from surveyloom.operators.encoding import column_moments
from surveyloom.operators.selection import grouped_quantiles
from surveyloom.session import fresh_path

# ---------------------------------------------------------------- trees


def tree_nodes(model: PipelineClassifier | BoostedTrees) -> DataFrame:
    """The nodes of a tree, forest or boosted model: tree, id, children, split, gain and row count.

    Those of Spark's trainers are read from the saved model, which Spark writes as a table of nodes.
    """
    spark = SparkSession.active()
    if isinstance(model, BoostedTrees):
        return model.node_table(spark)
    stage = model.stage
    if model.saved is None:
        model.saved = fresh_path(spark, "model")
        stage.save(model.saved)
    saved = spark.read.parquet(f"{model.saved}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    return saved.select(
        "tree",
        "id",
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature_index"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        "prediction",
        F.col("impurityStats").alias("stats"),
        "gain",
        F.col("rawCount").alias("n_rows"),
    )


def tree_importance(model: PipelineClassifier | BoostedTrees, kind: str = "gain") -> DataFrame:
    """(feature, score), highest first: mean gain per split, mean rows per split, or number of splits.

    The kind is read from the text: 'gain' or 'cover' anywhere in it, anything else counts splits.
    """
    text = kind.lower()
    if "gain" in text:
        score = F.avg("gain")
    elif "cover" in text:
        score = F.avg(F.col("n_rows").cast("double"))
    else:
        score = F.count("*").cast("double")
    names = F.array(*[F.lit(c) for c in model.features])
    inner = tree_nodes(model).where(F.col("left") >= 0)
    return (
        inner.groupBy(F.get(names, F.col("feature_index")).alias("feature"))
        .agg(score.alias("score"))
        .orderBy(F.desc("score"), "feature")
    )


# ---------------------------------------------------------------- Shapley contributions of trees


@dataclass
class Leaf:
    """A leaf as a box: the features its path tests, the open-closed interval of each, and its value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: float

    def __post_init__(self) -> None:
        if len(self.features) > 62:
            raise ValueError("a path that tests more than 62 features is not supported")

    def mask(self, x: np.ndarray) -> np.ndarray:
        """Per row, one bit for each tested feature that lies inside the box."""
        part = x[:, self.features]
        inside = (part > self.low) & (part <= self.high)
        return inside @ (1 << np.arange(len(self.features)))


def model_leaves(model: PipelineClassifier | BoostedTrees) -> list[Leaf]:
    """All leaves; values add up to the explained score (margin of boosted trees, else the probability)."""
    nodes = {(r["tree"], r["id"]): r for r in tree_nodes(model).collect()}  # one row per node of the model
    trees = sorted({t for t, _ in nodes})
    boosted = isinstance(model, BoostedTrees)
    if boosted:
        weights = dict(enumerate(model.weights))
    elif hasattr(model.stage, "treeWeights"):
        weights = dict(zip(trees, model.stage.treeWeights))
    else:
        weights = {0: 1.0}
    total = 1.0 if boosted else float(sum(weights.values()))
    leaves: list[Leaf] = []

    def walk(tree: int, node: int, box: dict[int, tuple[float, float]]) -> None:
        r = nodes[(tree, node)]
        if r["left"] < 0:
            own = r["prediction"] if boosted else r["stats"][1] / sum(r["stats"])
            feats = sorted(box)
            leaves.append(
                Leaf(
                    np.array(feats, dtype=int),
                    np.array([box[f][0] for f in feats]),
                    np.array([box[f][1] for f in feats]),
                    own * weights[tree] / total,
                )
            )
            return
        f, cut = r["feature_index"], r["threshold"]
        low, high = box.get(f, (-math.inf, math.inf))
        walk(tree, r["left"], {**box, f: (low, min(high, cut))})
        walk(tree, r["right"], {**box, f: (max(low, cut), high)})

    for t in trees:
        walk(t, 0, {})
    return leaves


def background_masks(background: DataFrame, features: Sequence[str], leaves: Sequence[Leaf]) -> list[dict[int, float]]:
    """For each leaf, the share of background rows per mask.

    Every background row counts; each task sends one total per leaf and seen mask, so the result has
    the size of the model.
    """
    boxes = list(leaves)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, int], int] = {}
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            for i, leaf in enumerate(boxes):
                seen, n = np.unique(leaf.mask(x), return_counts=True)
                for m, c in zip(seen.tolist(), n.tolist()):
                    counts[(i, m)] = counts.get((i, m), 0) + c
        if counts:
            keys = np.array(list(counts))
            yield pd.DataFrame({"leaf": keys[:, 0], "mask": keys[:, 1], "n": list(counts.values())})

    rows = (
        background.select(*[F.col(c).cast("double") for c in features])
        .mapInPandas(tally, "leaf long, mask long, n long")
        .groupBy("leaf", "mask")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out: list[dict[int, float]] = [{} for _ in boxes]
    for r in rows:
        out[r["leaf"]][r["mask"]] = r["n"]
    n = sum(out[0].values()) if out else 0
    if not n:
        raise ValueError("the background has no rows")
    return [{m: c / n for m, c in masks.items()} for masks in out]


def leaf_contribution(leaf: Leaf, own: int, shares: Mapping[int, float]) -> np.ndarray:
    """Contribution of each tested feature of one leaf to a row with mask ``own``.

    Against one background row, the leaf is reached by a coalition that holds every feature only the
    explained row satisfies (a of them) and none that only the background row satisfies (b of them).
    Its value is shared as in a unanimity game on those: +(a-1)! b! / (a+b)! for the first kind,
    -a! (b-1)! / (a+b)! for the second.
    """
    k = len(leaf.features)
    full = (1 << k) - 1
    phi = np.zeros(k)
    bits = np.arange(k)
    for other, share in shares.items():
        if own | other != full:
            continue
        mine, theirs = own & ~other, other & ~own
        a, b = mine.bit_count(), theirs.bit_count()
        if a == 0 and b == 0:
            continue
        scale = share * leaf.value / math.factorial(a + b)
        if a:
            phi += ((mine >> bits) & 1) * (scale * math.factorial(a - 1) * math.factorial(b))
        if b:
            phi -= ((theirs >> bits) & 1) * (scale * math.factorial(a) * math.factorial(b - 1))
    return phi


def shapley_rows(model: PipelineClassifier | BoostedTrees, df: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """(key, feature, value, contribution, base): exact Shapley values of a tree model for every row.

    The value of a coalition is the mean score over the whole background with the coalition's features
    taken from the row. ``base`` is the mean background score, and base plus the contributions is the
    row's score. Rows stay in their partition.
    """
    features = list(model.features)
    leaves = model_leaves(model)
    shares = background_masks(background, features, leaves)
    base = float(sum(lf.value * s.get((1 << len(lf.features)) - 1, 0.0) for lf, s in zip(leaves, shares)))

    @F.pandas_udf("array<double>")
    def contributions(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for cols in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            out = np.zeros_like(x)
            for i, leaf in enumerate(leaves):
                seen, where = np.unique(leaf.mask(x), return_inverse=True)
                for m in seen.tolist():
                    if (i, m) not in known:
                        known[(i, m)] = leaf_contribution(leaf, m, shares[i])
                out[:, leaf.features] += np.stack([known[(i, m)] for m in seen.tolist()])[where]
            yield pd.Series(list(out))

    phi = contributions(*[F.col(c).cast("double") for c in features])
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            F.get("_phi", F.lit(i)).alias("contribution"),
        )
        for i, c in enumerate(features)
    ]
    return df.withColumn("_phi", phi).select(
        key, F.inline(F.array(*entries)), F.lit(base).alias("base")
    )


def shapley_linear(
    df: DataFrame, background: DataFrame, coefficients: Mapping[str, float], intercept: float, key: str
) -> DataFrame:
    """As ``shapley_rows`` for a linear score: weight times the distance to the background mean."""
    means = {c: m for c, (m, _) in column_moments(background, list(coefficients)).items()}
    base = intercept + sum(w * means[c] for c, w in coefficients.items())
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(c).cast("double") - F.lit(means[c]))).alias("contribution"),
        )
        for c, w in coefficients.items()
    ]
    return df.select(key, F.inline(F.array(*entries)), F.lit(float(base)).alias("base"))


# ---------------------------------------------------------------- views on contributions


def shapley_summary(contributions: DataFrame, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per feature: mean absolute contribution, its quantiles, and its correlation with the feature value."""
    spread_of = F.stddev_pop("value") * F.stddev_pop("contribution")
    means = contributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"),
        F.try_divide(F.covar_pop("value", "contribution"), spread_of).alias("value_corr"),
    )
    long = contributions.select("feature", "contribution")
    spread = (
        grouped_quantiles(long, probs, "feature", "contribution")
        .groupBy("feature")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{round(p * 100):02d}")
                for p in probs
            ]
        )
    )
    return means.join(spread, "feature").orderBy(F.desc("mean_abs"), "feature")


def force_rows(contributions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Breakdown of chosen rows: base, contribution per feature and their sum, the score."""
    picked = contributions.join(rows.select(key), key, "left_semi")
    score = picked.groupBy(key).agg((F.first("base") + F.sum("contribution")).alias("score"))
    return picked.join(score, key).select(key, "feature", "value", "contribution", "base", "score")


def dependence(contributions: DataFrame, feature: str | None = None) -> DataFrame:
    """(feature, value, mean contribution, rows) for one feature or all."""
    rows = contributions if feature is None else contributions.where(F.col("feature") == feature)
    return rows.groupBy("feature", "value").agg(
        F.avg("contribution").alias("contribution"), F.count("*").alias("n")
    )


# ---------------------------------------------------------------- local surrogate


@dataclass
class Bins:
    """Quartile bins of one feature: upper edges, and share, mean, std, min and max of the training rows in each."""

    edges: list[float]
    share: list[float]
    stats: list[tuple[float, float, float, float]]

    def number(self, x: Column) -> Column:
        out = F.lit(0)
        for e in self.edges:
            out = out + F.when(x > F.lit(e), 1).otherwise(0)
        return out


def quartile_bins(train: DataFrame, features: Sequence[str]) -> dict[str, Bins]:
    """Bins of every feature from two passes over the training rows; quartiles come from counted values."""
    typed = train.select(*[F.col(c).cast("double").alias(c) for c in features])
    long = typed.unpivot([], list(features), "feature", "value")
    edges: dict[str, set] = {c: set() for c in features}
    values = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    for r in grouped_quantiles(values, [0.25, 0.5, 0.75], copies="n").collect():
        edges[r["feature"]].add(r["quantile"])
    out = {c: Bins(sorted(edges[c]), [], []) for c in features}
    number = F.lit(None).cast("int")
    for c in features:
        number = F.when(F.col("feature") == c, out[c].number(F.col("value"))).otherwise(number)
    v = F.col("value")
    rows = (
        long.where(v.isNotNull())
        .groupBy("feature", number.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        .collect()
    )
    for c in features:
        got = {r["bin"]: r for r in rows if r["feature"] == c}
        total = sum(r["n"] for r in got.values())
        for b in range(len(out[c].edges) + 1):
            r = got.get(b)
            out[c].share.append(r["n"] / total if r else 0.0)
            out[c].stats.append((r["m"], r["s"], r["lo"], r["hi"]) if r else (0.0, 0.0, 0.0, 0.0))
    return out


def lime_explain(
    model,
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    key: str,
    n_samples: int = 5000,
    kernel_width: float | None = None,
    ridge: float = 1.0,
    seed: int = 1,
    bins: Mapping[str, Bins] | None = None,
) -> DataFrame:
    """(key, feature, weight, intercept, local_prediction) for each row, strongest feature first by ``place``.

    Around each row, samples are drawn bin by bin as the training rows are spread; the model scores
    them; and a ridge regression on "same bin as the row", weighted by nearness, gives the weights.
    Samples are spread over the cluster and reach the solver as sums, one small matrix per row.
    ``bins`` are those of ``quartile_bins`` for the same training rows, for callers that explain more than one model.
    """
    features = list(features)
    d = len(features)
    width = kernel_width or 0.75 * math.sqrt(d)
    bins = quartile_bins(train, features) if bins is None else bins
    keep = [key, *features]
    grid = (
        rows.select(*keep)
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(63))))
        .repartition(key, "_part")
        .withColumn("_draw", F.explode(F.sequence("_part", F.lit(max(63, n_samples - 1)), F.lit(64))))
        .where(F.col("_draw") < n_samples)
    )

    def lookup(values: Sequence[float], at: Column) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), at)

    first = F.col("_draw") == 0  # the row itself
    drawn, placed = {}, {}
    for i, c in enumerate(features):
        b = bins[c]
        u, u1, u2 = (uniform(seed * 1000 + 3 * i + j, F.col(key), F.col("_draw")) for j in range(3))
        at = F.lit(0)
        for edge in np.cumsum(b.share)[:-1]:
            at = at + F.when(u > F.lit(float(edge)), 1).otherwise(0)
        normal = F.sqrt(-2 * F.ln(u1)) * F.cos(u2 * (2 * math.pi))
        drawn |= {f"_own{i}": b.number(F.col(c).cast("double")), f"_bin{i}": at, f"_z{i}": normal}
        at = F.col(f"_bin{i}")
        mean, std, low, high = (lookup([s[j] for s in b.stats], at) for j in range(4))
        value = F.least(F.greatest(mean + std * F.col(f"_z{i}"), low), high)
        placed[f"_same{i}"] = F.when(first | (at == F.col(f"_own{i}")), 1.0).otherwise(0.0)
        placed[f"_x{i}"] = F.when(first, F.col(c).cast("double")).otherwise(value)
    grid = grid.withColumns(drawn).withColumns(placed)
    sample = grid.select(
        F.col(key).alias("_key"), "_draw", *[F.col(f"_x{i}").alias(c) for i, c in enumerate(features)],
        *[f"_same{i}" for i in range(d)],
    )
    scored = model.predict(sample)
    same = [F.col(f"_same{i}") for i in range(d)]
    off = sum((1 - s for s in same), F.lit(0.0))
    scored = scored.withColumn("_w", F.sqrt(F.exp(-off / (width * width))))
    base = [F.lit(1.0), *same]
    products = [F.sum(F.col("_w") * base[i] * base[j]) for i in range(d + 1) for j in range(i, d + 1)]
    targets = [F.sum(F.col("_w") * base[i] * F.col("probability")) for i in range(d + 1)]
    sums = scored.groupBy("_key").agg(F.array(*products).alias("xx"), F.array(*targets).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for flat, t in zip(xx, xy):
            a = np.zeros((d + 1, d + 1))
            a[np.triu_indices(d + 1)] = flat
            a = a + np.triu(a, 1).T
            a[1:, 1:] += ridge * np.eye(d)  # the intercept is not shrunk
            out.append(np.linalg.solve(a, np.asarray(t)))
        return pd.Series(out)

    beta = F.col("_beta")
    entries = [
        F.struct(F.lit(c).alias("feature"), F.get(beta, F.lit(i + 1)).alias("weight")) for i, c in enumerate(features)
    ]
    order = lambda a, b: (
        F.when(F.abs(a["weight"]) > F.abs(b["weight"]), -1)
        .when(F.abs(a["weight"]) < F.abs(b["weight"]), 1)
        .when(a["feature"] < b["feature"], -1)
        .otherwise(1)
    )
    total = F.aggregate(beta, F.lit(0.0), lambda acc, v: acc + v)
    solved = sums.withColumn("_beta", solve("xx", "xy"))
    ranked = solved.select(
        F.col("_key").alias(key), F.posexplode(F.array_sort(F.array(*entries), order)).alias("place", "e"),
        F.get(beta, F.lit(0)).alias("intercept"), total.alias("local_prediction"),
    )
    return ranked.select(key, "place", "e.feature", "e.weight", "intercept", "local_prediction")
