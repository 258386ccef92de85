"""Turning columns into model inputs: integer codes, a dimension table, standard scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.rank import prefix_sums


def code_table(df: DataFrame, col: str, key: str) -> DataFrame:
    """(value, code): codes 0, 1, ... in order of first appearance by row key."""
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(key).alias("_first"))
    numbered = prefix_sums(firsts.withColumn("_one", F.lit(1).cast("long")), "_first", ["_one"])
    return numbered.select(col, F.col("_one_before").cast("int").alias("code"))


def factorize(df: DataFrame, col: str, key: str, out: str = "code") -> DataFrame:
    """Every row with the code of its value; null gets -1."""
    codes = code_table(df, col, key).withColumnRenamed("code", out)
    return df.join(codes, col, "left").select(*df.columns, F.coalesce(F.col(out), F.lit(-1)).alias(out))


def dimension_table(df: DataFrame, col: str, key: str, dedup: bool = True) -> DataFrame:
    """Value and code; one row per value, or with ``dedup=False`` one per input row."""
    if dedup:
        return code_table(df, col, key)
    return factorize(df, col, key).select(col, "code")


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column."""
    aggs = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols]
    row = df.agg(*aggs).first()
    return {c: (row[c]["mean"], row[c]["std"]) for c in cols}


def standard_score(col: str, mean: float, std: float) -> Column:
    """(x - mean) / std; a column without spread becomes 0."""
    x = F.col(col).cast("double") - F.lit(float(mean or 0.0))
    return x / F.lit(float(std)) if std else x * F.lit(0.0)


def standardize(df: DataFrame, cols: Sequence[str], moments: dict | None = None) -> DataFrame:
    """Replace the columns by their standard scores, with the moments of ``df`` or given ones."""
    moments = moments or column_moments(df, cols)
    scores = {c: standard_score(c, *moments[c]) for c in cols}
    return df.select(*[scores[c].alias(c) if c in scores else F.col(c) for c in df.columns])
