"""Reproducible splits and folds with exact sizes. Every one is a projection over the input rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.hashing import key_hash
from surveyloom.operators.rank import hash_cuts
from surveyloom.schema import require_columns


def _by_group(group: str | None, per_group: dict) -> Column:
    """Pick the expression of the row's group."""
    if group is None:
        return per_group[0]
    out = F.lit(None)
    for value, expr in per_group.items():
        out = F.when(F.col(group) == F.lit(value), expr).otherwise(out)
    return out


def _check_size(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")


def train_test_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 1, out: str = "split"
) -> DataFrame:
    """Mark exactly ``ceil(n * test_size)`` rows as 'test' and the rest as 'train'."""
    require_columns(df, key)
    _check_size(test_size)
    cuts = hash_cuts(df, key, seed, lambda n: {0: [math.ceil(n.get(0, 0) * test_size)]})
    is_test = key_hash(key, seed) <= F.lit(cuts[0][0])
    return df.withColumn(out, F.when(is_test, "test").otherwise("train"))


def class_quotas(totals: dict, n_test: int) -> dict:
    """Share ``n_test`` rows among the classes by largest remainder (ties: smaller class first)."""
    n = sum(totals.values())
    quota = {c: k * n_test // n for c, k in totals.items()}
    by_remainder = sorted(totals, key=lambda c: (-(totals[c] * n_test % n), c))
    for c in by_remainder[: n_test - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 1, out: str = "split"
) -> DataFrame:
    """As ``train_test_split``, but each class keeps its share in both parts."""
    require_columns(df, key, label)
    _check_size(test_size)

    def ranks(totals: dict) -> dict:
        quota = class_quotas(totals, math.ceil(sum(totals.values()) * test_size)) if totals else {}
        return {c: [q] for c, q in quota.items()}

    cuts = hash_cuts(df, key, seed, ranks, group=label)
    limit = _by_group(label, {c: F.lit(v[0]) for c, v in cuts.items()})
    return df.withColumn(out, F.when(key_hash(key, seed) <= limit, "test").otherwise("train"))


def three_way_split(
    df: DataFrame, key: str, test_size: float = 0.2, val_size: float = 0.2, seed: int = 1, out: str = "split"
) -> DataFrame:
    """'test' as in ``train_test_split``; then ``ceil`` of ``val_size`` of the other rows become 'val'.

    Both cuts lie on one hash order: the first rows are the test set, the next ones validation.
    """
    require_columns(df, key)
    _check_size(test_size)
    _check_size(val_size)

    def ranks(totals: dict) -> dict:
        n = totals.get(0, 0)
        m = math.ceil(n * test_size)
        return {0: [m, m + math.ceil((n - m) * val_size)]}

    test_cut, val_cut = hash_cuts(df, key, seed, ranks)[0]
    h = F.col("_h")
    split = F.when(h <= F.lit(test_cut), "test").when(h <= F.lit(val_cut), "val").otherwise("train")
    return df.withColumn("_h", key_hash(key, seed)).withColumn(out, split).drop("_h")


def stratified_kfold(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Fold number 0..k-1 per row; inside a class the fold sizes differ by at most one row."""
    require_columns(df, key, label)
    if k < 2:
        raise ValueError("k must be at least 2")

    def ranks(totals: dict) -> dict:
        return {c: [j * (n // k) + min(j, n % k) for j in range(1, k)] for c, n in totals.items()}

    cuts = hash_cuts(df, key, seed, ranks, group=label)
    h = F.col("_h")
    folds = {}
    for c, edges in cuts.items():
        fold = F.lit(0)
        for e in edges:
            fold = fold + F.when(h > F.lit(e), 1).otherwise(0)
        folds[c] = fold
    return df.withColumn("_h", key_hash(key, seed)).withColumn(out, _by_group(label, folds).cast("int")).drop("_h")


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and share of all rows per split."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return (
        df.groupBy(split)
        .agg(F.count("*").alias("n"))
        .select(split, "n", (F.col("n").cast("double") / total).alias("share"))
    )
