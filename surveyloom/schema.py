"""Canonical survey schema and small schema helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LABEL = "label"
KEY = "case_id"
FEATURES = [
    "district_code", "gender", "severity", "diet", "smoke", "water", "toilet", "hard_access",
]
CATEGORIES = ["gender", "severity", "diet", "smoke", "water", "toilet", "hard_access"]

CASE_SCHEMA = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("district_name", T.StringType()),
        T.StructField("district_code", T.IntegerType()),
        T.StructField("gender", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("diet", T.IntegerType()),
        T.StructField("smoke", T.IntegerType()),
        T.StructField("water", T.IntegerType()),
        T.StructField("toilet", T.IntegerType()),
        T.StructField("hard_access", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
)


def require_columns(df: DataFrame, *cols: str) -> None:
    """Raise when a named column is missing, so an operator fails before any job starts."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
