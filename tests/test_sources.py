import pytest

from surveyloom.plans.cases import cases
from surveyloom.schema import CASE_SCHEMA
from surveyloom.session import fresh_path
from surveyloom.sources import files, jdbc, tables


def test_csv_needs_a_schema_and_nulls_what_does_not_fit(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text("k,v\n1,2\n2,x\n")
    with pytest.raises(ValueError):
        files.load_table(spark, path)
    got = files.load_table(spark, path, "k long, v int")
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, 2), (2, None)]


def test_rename_checks_the_number_of_names(spark):
    with pytest.raises(ValueError):
        files.canonical_rename(spark.range(1), ["a", "b"])


def test_tables_are_created_once_and_replaced(spark):
    df = cases(spark, "/root/testdata/sf0.001")
    assert df.schema.names == CASE_SCHEMA.names
    path = fresh_path(spark, "once")
    tables.create_table(df, "cases_once", path)
    try:
        with pytest.raises(Exception, match="ALREADY_EXISTS"):
            tables.create_table(df, "cases_once", path)
        tables.replace_table(df.limit(3), "cases_once", path)
        assert tables.read_table(spark, "cases_once").count() == 3
        df.createOrReplaceTempView("cases_view")
        assert "cases_once" in tables.list_base_tables(spark)
        assert "cases_view" not in tables.list_base_tables(spark)
        assert "cases_view" in tables.list_tables(spark)
    finally:
        spark.sql("DROP TABLE cases_once")
        spark.catalog.dropTempView("cases_view")


def test_queries_are_checked_and_cleaned():
    assert jdbc.clean_query("SELECT * FROM rawdata;\n") == "SELECT * FROM rawdata"
    with pytest.raises(ValueError):
        jdbc.clean_query("SELECT 1;")


def test_connection_from_arguments_configuration_or_nothing(spark, monkeypatch):
    assert jdbc.connection(spark) is None
    assert jdbc.connection(spark, {"user": "u"}) is None
    assert jdbc.connection(spark, {"url": "jdbc:x", "user": "u"}) == {"url": "jdbc:x", "user": "u"}
    monkeypatch.setenv("SURVEYLOOM_JDBC_URL", "jdbc:y")
    assert jdbc.connection(spark) == {"url": "jdbc:y"}


def test_remote_options(spark):
    df = spark.createDataFrame([("a", 1)], "district_name string, district_id int")
    assert jdbc.declared_types(df) == "district_name VARCHAR(30), district_id INT"
    assert jdbc.declared_types(df, {"district_name": "VARCHAR(60)"}).startswith("district_name VARCHAR(60)")
    assert jdbc.Stride("k", 0, 100, 4).options() == {
        "partitionColumn": "k", "lowerBound": "0", "upperBound": "100", "numPartitions": "4",
    }


def test_release_removes_only_what_the_application_stored(spark):
    import os

    from surveyloom import session

    other = f"{session.shared_dir(spark)}/not-ours-{os.getpid()}".removeprefix("file:")
    os.makedirs(other)
    stored = session.materialize(spark.range(3).toDF("k"), "kept")
    [file] = {f.removeprefix("file://").rpartition("/")[0] for f in stored.inputFiles()}
    assert os.path.isdir(file)
    session.release(spark)
    assert not os.path.exists(file) and os.path.isdir(other)
    os.rmdir(other)
