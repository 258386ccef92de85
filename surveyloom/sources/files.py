"""Reading survey files with a declared schema, and renaming to the canonical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Read a CSV or Parquet file or folder. CSV needs a schema: nothing is inferred.

    A CSV cell that does not fit its type becomes null.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV file needs a declared schema")
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format {fmt}")


def canonical_rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename all columns by position; the number of names must fit."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)
