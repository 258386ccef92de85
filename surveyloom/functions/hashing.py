"""Seeded pseudo-random columns that depend on the row key alone.

The order they give is the same for every partitioning and on every recomputation, and any SQL engine
with md5 can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: str | Column, seed: int) -> Column:
    """32 hex digits drawn from the key and the seed."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))))


def uniform(seed: int, *parts: Column) -> Column:
    """A double in (0, 1) drawn from the given columns and the seed."""
    h = F.xxhash64(F.lit(seed), *parts)
    low52 = h.bitwiseAND(F.lit((1 << 52) - 1))
    return (low52.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
