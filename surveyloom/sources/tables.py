"""Catalog tables: replace, create, append distinct rows, list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Store the rows under the name, replacing what was there."""
    _save(df, name, "overwrite", path)


def create_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Store the rows under a new name; an existing table makes it fail."""
    _save(df, name, "errorifexists", path)


def _save(df: DataFrame, name: str, mode: str, path: str | None) -> None:
    writer = df.write.mode(mode)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def append_distinct(df: DataFrame, name: str) -> None:
    """Append the distinct rows of the frame."""
    df.dropDuplicates().write.mode("append").saveAsTable(name)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of all tables and views."""
    return sorted(t.name for t in spark.catalog.listTables(database))


def list_base_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the stored tables: no view, nothing temporary."""
    found = spark.catalog.listTables(database)
    return sorted(t.name for t in found if not t.isTemporary and t.tableType != "VIEW")
