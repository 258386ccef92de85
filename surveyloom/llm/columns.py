"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with underscores appended until no column of ``df`` has the name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; a plain reference inside a lambda is computed for each element."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_digest(id_col: Column, text: Column) -> Column:
    """64 bits of id and text. Rows that agree in both are copies of one row and get the same results."""
    return F.xxhash64(F.lit(11), id_col, text)


def same(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out
