"""Order statistics by counting leading bits, on values of every size, and rows by position."""

import datetime as dt

import numpy as np
import pytest

from surveyloom.operators import sampling, selection

ODD = [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, float("inf"), float("-inf"), 1.0, np.nextafter(1.0, 2.0), -1.0, 5e-324]


def test_keys_keep_the_order_of_doubles():
    rng = np.random.default_rng(1)
    x = np.concatenate([ODD, rng.normal(0, 1, 500), rng.normal(0, 1e200, 200), rng.integers(-5, 5, 200)])
    keys = selection.double_keys(x)
    order = np.argsort(x, kind="stable")
    assert (np.diff(keys[order]) >= 0).all() and ((np.diff(keys[order]) == 0) == (np.diff(x[order]) == 0)).all()
    assert [selection.double_of(int(k)) for k in keys] == x.tolist()


@pytest.mark.parametrize("kind", ["odd", "ties", "near", "one"])
def test_every_rank_is_found(spark, kind):
    rng = np.random.default_rng(2)
    x = {
        "odd": ODD * 3, "ties": [7.0] * 400 + [8.0] * 3, "near": (1 + np.arange(300) * 2.0**-52).tolist(), "one": [3.5],
    }[kind]
    x = [float(v) for v in rng.permutation(x)]
    rows = [("a", v) for v in x] + [("b", -v) for v in x] + [("a", None), (None, float("nan"))]
    keyed = selection.keyed_doubles(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v")
    assert selection.group_sizes(keyed) == {"a": len(x), "b": len(x)}
    ranks = range(0, len(x), max(1, len(x) // 40))
    found = selection.select_ranks(keyed, {"a": ranks, "b": ranks})
    for g, values in (("a", sorted(x)), ("b", sorted(-v for v in x))):
        assert [selection.double_of(found[g, r]) for r in ranks] == [values[r] for r in ranks]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert selection.grouped_quantiles(df, [0.5], "g", "v").collect() == []


@pytest.mark.parametrize("kind", ["int", "long", "date", "timestamp", "string"])
def test_rows_of_a_range_by_any_key(spark, kind):
    make = {
        "int": lambda k: k - 50, "long": lambda k: (k - 50) * 10**16 + k, "date": lambda k: dt.date(1969, 1, 1) + dt.timedelta(days=11 * k),
        "timestamp": lambda k: dt.datetime(1969, 12, 1) + dt.timedelta(hours=9 * k, microseconds=k), "string": lambda k: f"k{k:04}",
    }[kind]
    rows = [(make(k), k) for k in np.random.default_rng(3).permutation(200).tolist()]
    df = spark.createDataFrame(rows, f"key {kind}, place int").repartition(3)
    got = [(r["position"], r["place"]) for r in sampling.sample_range(df, "key", 30, 40, 12).collect()]
    assert len(got) == 12 and all(a == b and 30 <= a <= 70 for a, b in got) and got == sorted(got)
    everything = [r["position"] for r in sampling.sample_range(df, "key", 190, 20, 21).collect()]
    assert everything == list(range(190, 200))
    assert sampling.sample_range(df, "key", 500, 5, 2).count() == 0


def test_counted_values_have_the_quantiles_of_their_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, most in (("a", 4), ("b", 50)) for v in rng.integers(-most, most, 301)] + [("a", None), ("b", float("nan"))]
    long = spark.createDataFrame(rows, "feature string, value double").repartition(5)
    counted = long.groupBy("feature", "value").count()
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    want = sorted(map(tuple, selection.grouped_quantiles(long, probs).collect()))
    assert sorted(map(tuple, selection.grouped_quantiles(counted, probs, copies="count").collect())) == want
    assert want == sorted((g, p, float(np.quantile([v for h, v in rows if h == g and v is not None and v == v], p))) for g in "ab" for p in probs)
