"""Global ranks without a global sort in one task.

Rows that share a value are folded first, so a value held by a third of the table is one row from
then on. The distinct values are dealt out by range, which their sampled bounds keep even whatever their
distribution is, and stored. Each range's total becomes an offset, and only the ordering inside a range needs a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.hashing import key_hash
from surveyloom.session import materialize


def prefix_sums(table: DataFrame, order: str, sums: Sequence[str], group: str | None = None) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over rows of the same group with a smaller ``order``.

    ``(group, order)`` must be unique and not null; both may be of any type that can be ordered.
    """
    g = F.lit(0) if group is None else F.col(group)
    ranged = table.withColumn("_group", g).repartitionByRange("_group", order).withColumn("_range", F.spark_partition_id())
    stored = materialize(ranged, "ranged")
    before = (Window.unboundedPreceding, -1)
    # One row per group and range that holds some of it.
    totals = stored.groupBy("_group", "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(*before)
    offsets = totals.select(
        "_group", "_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inside = Window.partitionBy("_group", "_range").orderBy(order).rowsBetween(*before)
    out = stored.join(offsets, ["_group", "_range"])
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.select(*table.columns, *[f"{c}_before" for c in sums])


def value_ranks(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """One row per distinct value: its count ``n`` and its average rank ``avg_rank`` (ties share it)."""
    keys = [value] if group is None else [group, value]
    counted = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    summed = prefix_sums(counted, value, ["n"], group)
    return summed.select(
        *keys, "n", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank")
    )


def bucket_rank(df: DataFrame, value: str, group: str | None = None, out: str = "avg_rank") -> DataFrame:
    """Every row with the average rank of its value, over the table or per group. Null values get null."""
    ranks = value_ranks(df, value, group).drop("n").withColumnRenamed("avg_rank", out)
    keys = [value] if group is None else [group, value]
    return df.join(ranks, keys, "left").select(*df.columns, out)


def key_positions(df: DataFrame, key: str, out: str = "position") -> DataFrame:
    """(key, position): the zero-based place of every row in key order; the key must be unique."""
    keyed = df.select(key, F.lit(1).cast("long").alias("_one"))
    return prefix_sums(keyed, key, ["_one"]).select(key, F.col("_one_before").alias(out))


def hash_cuts(df: DataFrame, key: str, seed: int, ranks, group: str | None = None, width: int = 3) -> dict:
    """Exact cut points in hash order: ``{group: [cut, ...]}``.

    ``ranks`` maps ``{group: row count}`` to ``{group: [r, ...]}``; for each r the returned cut is a hex
    text that exactly r rows of the group have a hash below or equal to. Hash prefixes are counted,
    and only the prefix holding the cut is counted again at finer width, so rows are never sorted
    and never leave their partition: a split built on the cuts is a projection.
    Each pass brings back at most ``16 ** width`` counts per open cut.
    """
    g = F.lit(0) if group is None else F.col(group)
    hashed = df.select(g.alias("_g"), key_hash(key, seed).alias("_h"))

    text: dict = {}  # each group as the engine writes it

    def count(depth: int, where: Column | None) -> dict:
        part = hashed if where is None else hashed.where(where)
        by = ["_g", F.col("_g").cast("string").alias("_t"), F.substring("_h", 1, depth).alias("_p")]
        found: dict = {}
        for r in part.groupBy(*by).agg(F.count("*").alias("n")).collect():
            text[r["_g"]] = r["_t"]
            found.setdefault(r["_g"], []).append((r["_p"], r["n"]))
        return {k: sorted(v) for k, v in found.items()}

    first = count(width, None)
    if None in first:
        raise ValueError(f"column {group} must not be null")
    totals = {k: sum(n for _, n in v) for k, v in first.items()}
    wanted = ranks(totals)
    cuts: dict = {k: [None] * len(v) for k, v in wanted.items()}
    todo = [(k, i, r, "", 0) for k, rs in wanted.items() for i, r in enumerate(rs)]
    depth, counts = width, {(k, ""): v for k, v in first.items()}
    while todo:
        later = []
        for k, i, r, prefix, before in todo:
            if r <= 0:
                cuts[k][i] = ""
                continue
            seen = before
            for p, n in counts[(k, prefix)]:
                if seen + n >= r:
                    break
                seen += n
            if seen + n == r:
                cuts[k][i] = p + "f" * (32 - len(p))
            else:
                later.append((k, i, r, p, seen))
        if not later:
            break
        if depth + width > 32:
            raise ValueError(f"{key} is not unique: equal keys cannot be split")
        depth += width
        open_at = {(k, p) for k, _, _, p, _ in later}
        # One text per row, so that the hash is computed once per row.
        mark = F.concat_ws(":", F.substring("_h", 1, depth - width), F.col("_g").cast("string"))
        finer = count(depth, mark.isin([f"{p}:{text[k]}" for k, p in open_at]))
        counts = {(k, p): [x for x in finer[k] if x[0].startswith(p)] for k, p in open_at}
        todo = later
    return cuts
