"""Exact order statistics by radix selection.

Every value becomes a 64-bit key in the order of the values, stored once. A pass counts the next ``BITS`` bits of the keys that share
the bits found so far with a wanted rank, for all groups and ranks together; five passes find every key, whatever the
distribution, the number of ties or the number of rows. Counting is a partial aggregate, so rows are never sorted or shuffled.
A few numbers per group and rank reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.session import discard, materialize

BITS = 13
#: Shifts of the passes: the first takes the 12 leading bits, the others 13 each.
SHIFTS = (52, 39, 26, 13, 0)


def double_keys(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles; both zeros get the same one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits)


def double_of(key: int) -> float:
    bits = np.array([key], np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits).view(np.float64)[0])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = double_keys(batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), *batch.columns[2:]], names=["g", "key", *batch.schema.names[2:]])


def keyed_doubles(long: DataFrame, group: str, value: str, copies: str | None = None) -> DataFrame:
    """(g, key) of the present values, stored; with ``copies``, a column of how often each row counts, (g, key, n)."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    n = [F.col(copies).cast("long").alias("n")] if copies else []
    rows = long.select(F.col(group).alias("g"), x.alias("v"), *n).where("v is not null")
    return materialize(rows.mapInArrow(_keyed, f"g {rows.schema['g'].dataType.simpleString()}, key long" + ", n long" * len(n)), "ordered-keys")


def _digit(shift: int) -> Column:
    return F.shiftright("key", shift) if shift == SHIFTS[0] else F.shiftright("key", shift).bitwiseAND((1 << BITS) - 1)


def _copies(keyed: DataFrame) -> Column:
    return F.col("n") if "n" in keyed.columns else F.lit(1).cast("long").alias("n")


def group_sizes(keyed: DataFrame) -> dict:
    return {r["g"]: r["n"] for r in keyed.select("g", _copies(keyed)).groupBy("g").agg(F.sum("n").alias("n")).collect()}


def select_ranks(keyed: DataFrame, ranks: Mapping[object, Sequence[int]]) -> dict[tuple[object, int], int]:
    """(group, rank) -> key for zero-based ranks below the group's size, of a stored table (g, key long) of values, or (g, key long, n long) of counted values."""
    spark = keyed.sparkSession
    wanted = [(g, int(r), 0, int(r)) for g, rs in ranks.items() for r in sorted(set(rs))]  # group, rank, bits so far, rank among these
    if not wanted:
        return {}
    kind = keyed.schema["g"].dataType.simpleString()
    for shift in SHIFTS:
        first = shift == SHIFTS[0]
        prefix = F.lit(0).cast("long") if first else F.shiftright("key", shift + BITS)
        rows = keyed.select("g", prefix.alias("prefix"), _digit(shift).alias("digit"), _copies(keyed))
        table = spark.createDataFrame(wanted, f"wg {kind}, rank long, wp long, place long")  # groups x ranks
        if first:
            near = rows
        else:
            open_at = F.broadcast(table.select("wg", "wp").distinct())
            near = rows.join(open_at, (F.col("g") == F.col("wg")) & (F.col("prefix") == F.col("wp")), "left_semi")
        counts = near.groupBy("g", "prefix", "digit").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("g", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        inside = (F.col("g") == F.col("wg")) & (F.col("prefix") == F.col("wp")) & (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
        found = summed.join(F.broadcast(table), inside).select("wg", "rank", "wp", "digit", (F.col("place") - F.col("before")).alias("left"))
        wanted = [(r["wg"], r["rank"], r["digit"] if first else (r["wp"] << BITS) + r["digit"], r["left"]) for r in found.collect()]
    return {(g, rank): key for g, rank, key, _ in wanted}


def grouped_quantiles(long: DataFrame, probs: Sequence[float], group: str = "feature", value: str = "value", copies: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) per group: (group, prob, quantile). Null and NaN are left out.

    ``copies`` names a column that says how many values a row stands for (one or more)."""
    spark = long.sparkSession
    keyed = keyed_doubles(long, group, value, copies)
    sizes = group_sizes(keyed)
    at = {(g, p): (n - 1) * p for g, n in sizes.items() for p in probs}
    ranks: dict = {}
    for (g, _), x in at.items():
        ranks.setdefault(g, set()).update({int(np.floor(x)), int(np.ceil(x))})
    keys = select_ranks(keyed, ranks)
    discard(keyed)
    rows = []
    for (g, p), x in at.items():
        low, high = (double_of(keys[g, int(k)]) for k in (np.floor(x), np.ceil(x)))
        part = x - np.floor(x)
        rows.append((g, float(p), float(low + (high - low) * part) if part else low))
    return spark.createDataFrame(rows, f"{group} {long.schema[group].dataType.simpleString()}, prob double, quantile double")
