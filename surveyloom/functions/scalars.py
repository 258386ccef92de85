"""Ratios, percents, label names and date text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date text layouts per grain.
DATE_LAYOUTS = {"year": "yyyy", "month": "yyyy-M", "day": "yyyy-M-d"}


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    return F.lit(100.0) * num.cast("double") / den.cast("double")


def percent_text(share: Column) -> Column:
    """A share of 1 as text with one decimal, e.g. 0.125 -> '12.5%'."""
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))


def label_name(value: Column, names: Mapping[int, str]) -> Column:
    """Text name of a coded value; codes without a name keep their own text."""
    out = value.cast("string")
    for code, name in names.items():
        out = F.when(value == code, F.lit(name)).otherwise(out)
    return out


def parse_date(text: Column, unit: str = "day") -> Column:
    """Timestamp (without zone) of date text at year, month or day grain; null where it cannot be read.

    Any other unit means day.
    """
    layout = DATE_LAYOUTS.get(unit, DATE_LAYOUTS["day"])
    return F.try_to_date(text, layout).cast("timestamp_ntz")
