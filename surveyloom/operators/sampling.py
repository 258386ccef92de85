"""Row selection: first rows, seeded samples, rows by key, aligned tables, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.hashing import key_hash
from surveyloom.operators.rank import hash_cuts, key_positions
from surveyloom.operators.selection import select_ranks
from surveyloom.schema import require_columns
from surveyloom.session import discard, materialize


def head_n(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First n rows in key order."""
    return df.orderBy(key).limit(n)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly n rows (all, when there are fewer), the same ones for the same seed.

    The rows are those up to a cut in the order of the key's hash, so none is sorted or moved. Keys must be unique.
    """
    require_columns(df, key)
    cuts = hash_cuts(df, key, seed, lambda t: {0: [min(n, t.get(0, 0))]})
    return df.where(key_hash(key, seed) <= F.lit(cuts[0][0]))


def _ordered_key(df: DataFrame, key: str) -> DataFrame | None:
    """(g, key) with the key as a 64-bit number in its own order, or None for types that have no such number."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        number = F.col(key).cast("long")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(key).cast("long")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(key)
    else:
        return None
    return df.where(F.col(key).isNotNull()).select(F.lit(0).alias("g"), number.alias("key"))


def sample_range(df: DataFrame, key: str, start: int, span: int, n: int = 5, seed: int = 2) -> DataFrame:
    """n different rows from the positions ``start .. start + span`` (in key order), by position.

    The positions are drawn first, and their keys are found by counting leading bits, so rows are neither sorted nor numbered; only keys
    that are no numbers, such as text, are ranked. Asking for more rows than there are positions is an error.
    """
    if n > span + 1:
        raise ValueError("more rows asked for than positions in the range")
    ordered = _ordered_key(df, key)
    if ordered is None:
        window = key_positions(df, key).where(F.col("position").between(start, start + span))
        picked = window.orderBy(key_hash("position", seed)).limit(n)
        return df.join(picked, key).orderBy("position")
    stored = materialize(ordered, "row-keys")
    last = min(start + span, stored.count() - 1)
    places = df.sparkSession.range(start, max(start, last + 1)).orderBy(key_hash("id", seed)).limit(n).collect()
    keys = select_ranks(stored, {0: [r["id"] for r in places]})
    discard(stored)
    table = df.sparkSession.createDataFrame([(k, position) for (_, position), k in keys.items()], "_number long, position long")  # n rows
    number = {"date": F.date_from_unix_date(F.col("_number").cast("int")), "timestamp": F.timestamp_micros("_number")}
    found = number.get(df.schema[key].dataType.typeName(), F.col("_number")).cast(df.schema[key].dataType)
    return df.join(F.broadcast(table.select(found.alias(key), "position")), key).orderBy("position")


def rows_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the key table."""
    return df.join(keys.select(key), key, "left_semi")


def align_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join two tables that describe the same rows, one to one.

    A key that is missing on a side or occurs twice makes the query fail: rows would be lost or doubled.
    """
    require_columns(left, key)
    require_columns(right, key)
    lefts = left.groupBy(key).agg(F.count("*").alias("_nl"), *[F.first(c).alias(c) for c in left.columns if c != key])
    rights = right.groupBy(key).agg(
        F.count("*").alias("_nr"), *[F.first(c).alias(c) for c in right.columns if c != key]
    )
    both = lefts.join(rights, key, "full")
    bad = F.coalesce((F.col("_nl") != 1) | (F.col("_nr") != 1), F.lit(True))
    problem = F.concat(F.lit("key is not one to one: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = both.withColumn(key, F.when(bad, F.raise_error(problem).cast(left.schema[key].dataType)).otherwise(F.col(key)))
    names = [c for c in left.columns if c != key] + [c for c in right.columns if c != key]
    return checked.where(F.col("_nl").isNotNull() | F.col("_nr").isNotNull()).select(key, *names)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))
