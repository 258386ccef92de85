"""Dated values: parsing at a grain, and the forecast band table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.scalars import parse_date


def _date_or_key(df: DataFrame, date: str, key: str) -> Column:
    return F.col(date) if date in df.columns else F.col(key)


def dated_series(df: DataFrame, key: str, date: str, value: str, unit: str = "day") -> DataFrame:
    """(key, date, value) with the date text parsed at the grain; rows whose date cannot be read are left out.

    Without a date column the row key is read as the date.
    """
    when = parse_date(_date_or_key(df, date, key).cast("string"), unit)
    return df.select(key, when.alias("date"), F.col(value).alias("value")).dropna(subset=["date"])


def forecast_band(
    df: DataFrame, key: str, date: str, original: str, predicted: str, upper: str, lower: str
) -> DataFrame:
    """Date, observed and predicted value, with the band when the table has one.

    Without a date column the row key takes its place.
    """
    picked = [
        _date_or_key(df, date, key).alias("date"),
        F.col(original).alias("original"),
        F.col(predicted).alias("predicted"),
    ]
    if upper in df.columns:
        picked += [F.col(upper).alias("upper"), F.col(lower).alias("lower")]
    return df.select(*picked)
