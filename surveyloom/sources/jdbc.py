"""Remote databases over Spark's JDBC source.

Executors read and write the database in parallel; connection settings come from arguments, from the
Spark configuration (``spark.surveyloom.jdbc.*``) or from the environment, never from files in the code.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTINGS = ("url", "user", "password", "driver")
# Queries up to this length are refused, and the catalogue query for the base tables of the public schema.
SHORTEST_QUERY = 10
PUBLIC_TABLES = (
    "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public' AND table_type = 'BASE TABLE'"
)


def connection(spark: SparkSession, given: Mapping[str, str] | None = None) -> dict[str, str] | None:
    """JDBC options from the arguments or the configured defaults; None when there is no address."""
    found = dict(given or {})
    if not found:
        for name in SETTINGS:
            value = spark.conf.get(f"spark.surveyloom.jdbc.{name}", None) or os.environ.get(f"SURVEYLOOM_JDBC_{name.upper()}")
            if value:
                found[name] = value
    return found if found.get("url") else None


def clean_query(query: str) -> str:
    """The query without its closing semicolon; one of 10 characters or fewer is refused."""
    if len(query) <= SHORTEST_QUERY:
        raise ValueError(f"a query must be longer than {SHORTEST_QUERY} characters")
    return query.strip().rstrip(";").rstrip()


def read_query(spark: SparkSession, options: Mapping[str, str], query: str) -> DataFrame:
    """Rows of a query, which the database evaluates."""
    return spark.read.format("jdbc").options(**options).option("query", clean_query(query)).load()


@dataclass(frozen=True)
class Stride:
    """How a large table is read in parallel: by ranges of a numeric or date column."""

    column: str
    lower: int | str
    upper: int | str
    parts: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.parts),
        }


def read_remote_table(
    spark: SparkSession, options: Mapping[str, str], table: str, stride: Stride | None = None, fetch: int = 10_000
) -> DataFrame:
    """A whole remote table. With a stride each task reads one range of it; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table).option("fetchsize", fetch)
    return (reader.options(**stride.options()) if stride else reader).load()


def list_remote_base_tables(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return read_query(spark, options, PUBLIC_TABLES)


# SQL column types per Spark type.
SQL_TYPES = {
    T.StringType: "VARCHAR(30)",
    T.IntegerType: "INT",
    T.LongType: "BIGINT",
    T.DoubleType: "DOUBLE",
}


def declared_types(df: DataFrame, types: Mapping[str, str] | None = None) -> str:
    """Column type list for table creation: given types first, defaults for the rest."""
    given = types or {}
    parts = []
    for f in df.schema.fields:
        sql = given.get(f.name) or SQL_TYPES.get(type(f.dataType))
        if sql:
            parts.append(f"{f.name} {sql}")
    return ", ".join(parts)


def replace_remote(df: DataFrame, options: Mapping[str, str], table: str, batch: int = 10_000) -> None:
    """Write the rows to a remote table, replacing it."""
    df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch).mode("overwrite").save()


def replace_remote_typed(
    df: DataFrame,
    options: Mapping[str, str],
    table: str,
    swap: Callable[[str, str], None],
    types: Mapping[str, str] | None = None,
    batch: int = 10_000,
) -> None:
    """Replace a remote table with declared column types, whole or not at all.

    Spark commits per partition, so the rows go to a staging table first. ``swap(staging, table)``
    then renames it in one database transaction; when the write fails the old table is untouched.
    """
    staging = f"{table}_{uuid.uuid4().hex[:8]}"
    (
        df.write.format("jdbc")
        .options(**options)
        .option("dbtable", staging)
        .option("createTableColumnTypes", declared_types(df, types))
        .option("batchsize", batch)
        .mode("errorifexists")
        .save()
    )
    swap(staging, table)


def append_remote_distinct(df: DataFrame, options: Mapping[str, str], table: str) -> None:
    """Append the distinct rows of the frame to an existing remote table."""
    df.dropDuplicates().write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()
