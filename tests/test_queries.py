import pytest
from compare import check, duck

import __spark_entry__ as entry_module

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_entry_has_rows_and_stable_schema(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["district_name", "negative", "positive"]
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    check(spark, con, name, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", ["rf_fit", "dt_fit", "lda_fit", "logreg_fit", "mlp_fit", "gbt_early_stop", "extra_trees_fit"])
def test_predictions_are_whole_and_good(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert len(rows) == 300
    assert all(r["prediction"] in (0.0, 1.0) and 0.0 <= r["probability"] <= 1.0 for r in rows)
    assert sum(r["prediction"] == r["label"] for r in rows) / len(rows) > 0.85
