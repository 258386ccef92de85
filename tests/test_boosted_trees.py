"""Boosted trees against plain code, and what their passes cost."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import staged
from surveyloom.operators.classifiers import boosted_trees, newton, trees
from surveyloom.operators.classifiers.boosted_stumps import cut_points, placed_rows

ROWS = [(k % 13 / 2, float(k * 7 % 5), float(k % 2), int((k % 13) + 3 * (k % 2) + (k * 31 % 7) > 9)) for k in range(400)]
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "a double, b double, c double, label int")


def plain_tree(x, target, depth):
    """Predictions of a regression tree; the split of the largest fall of the variance, the first among equals."""
    out = np.full(len(x), target.mean())
    if not depth:
        return out
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gain = (left.sum() * target[left].mean() ** 2 + (~left).sum() * target[~left].mean() ** 2) / len(x) - target.mean() ** 2
            if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                best = gain, left
    if best:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], target[side], depth - 1)
    return out


@pytest.mark.parametrize("cells", [1, boosted_trees.CELLS])
def test_all_rows_and_features_as_in_plain_code(table, monkeypatch, cells):
    monkeypatch.setattr(boosted_trees, "CELLS", cells)
    x, sign = np.array(ROWS)[:, :3], np.where(np.array(ROWS)[:, 3] > 0, 1.0, -1.0)
    margin = plain_tree(x, sign, 3)
    for _ in range(24):  # past the first state of the margins
        margin = margin + 0.3 * plain_tree(x, 4 * sign / (1 + np.exp(2 * sign * margin)), 3)
    model = trees.fit_boosting(table, NAMES, "label", n_estimators=25, learning_rate=0.3, subsample=1.0, colsample=1.0)
    got = {(r["a"], r["b"], r["c"]): r["probability"] for r in model.predict(table).collect()}
    for row, m in zip(ROWS, margin, strict=True):
        assert got[row[:3]] == pytest.approx(1 / (1 + math.exp(-2 * m)), abs=1e-9)


def test_drawn_trees_depend_on_rows_only(table, monkeypatch):
    monkeypatch.setattr(boosted_trees, "FEW", 10)
    fits = [trees.fit_boosting(df, NAMES, "label", n_estimators=6) for df in (table, table.repartition(7), table.orderBy(F.desc("a")))]
    monkeypatch.setattr(boosted_trees, "FEW", 10_000)
    monkeypatch.setattr(boosted_trees, "CELLS", 1)
    fits.append(trees.fit_boosting(table, NAMES, "label", n_estimators=6))
    first, *others = ([(r[0], r[4], r[5], r[8], pytest.approx(r[6], abs=1e-9)) for r in sorted(m.rows, key=lambda r: (r[0], r[4:6], r[8], r[6]))] for m in fits)
    assert all([r[:4] for r in o] == [r[:4] for r in first] for o in others)
    roots = {r[0]: r[8] for r in fits[0].rows if r[1] == 0}
    assert len(set(roots.values())) > 1 and all(270 < n < 370 for n in roots.values())  # 0.8 of 400 rows, drawn per tree


def test_one_job_per_tree(table):
    """A distributed tree trainer that takes a job per level and several to follow the margins needs more."""
    context = table.sparkSession.sparkContext

    def jobs(n):
        context.setJobGroup(f"boosting-{n}", "")
        trees.fit_boosting(table, NAMES, "label", n_estimators=n)
        return len(context.statusTracker().getJobIdsForGroup(f"boosting-{n}"))

    assert jobs(16) - jobs(4) <= 12 + 4


def test_held_rows_stop_the_fit(table):
    held = table.withColumn("held", F.rand(3) < 0.3)
    model = trees.fit_boosting(held, NAMES, "label", n_estimators=60, validation="held", tolerance=0.05)
    assert 1 <= len(model.weights) < 60
    with pytest.raises(ValueError, match="no validation rows"):
        trees.fit_boosting(table.withColumn("held", F.lit(False)), NAMES, "label", n_estimators=3, validation="held")


def test_counted_rows_have_the_area_of_all_rows(spark):
    rows = [(y, [0.1 * k, 0.1 * (k * 3 % 5)], n) for k, (y, n) in enumerate([(0, 3), (1, 1), (0, 2), (1, 5), (1, 2)])]
    counted = spark.createDataFrame(rows, "label int, margins array<double>, n int")
    repeated = spark.createDataFrame([r for r in rows for _ in range(r[2])], counted.schema)
    assert sorted(staged.staged_auc(counted, "label", count="n").collect()) == sorted(staged.staged_auc(repeated, "label").collect())


def test_passes_of_a_search_use_all_cores(table):
    """A short table of counted rows would otherwise be one file, and each pass of all candidates one task."""
    folded = table.withColumn("fold", F.lit(0))
    cores = table.sparkSession.sparkContext.defaultParallelism
    placed = placed_rows(folded, NAMES, "label", cut_points(folded, NAMES), "fold")
    counted = newton.counted_rows(folded, NAMES, "label", "fold")
    for stored in (placed, counted):
        assert stored.rdd.getNumPartitions() == cores
        assert stored.agg(F.sum("_n")).first()[0] == len(ROWS)
