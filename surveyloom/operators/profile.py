"""Describing a table: statistics, nulls, shares, crosstabs and rank correlation.

Reports read the table once for all columns, but for exact quantiles and rank correlation; per-column loops only build
expressions. NaN counts as missing, like null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.scalars import percent
from surveyloom.operators.rank import value_ranks
from surveyloom.operators.selection import grouped_quantiles
from surveyloom.schema import numeric_names
from surveyloom.session import materialize


def _present(df: DataFrame, name: str) -> Column:
    """Whether the column holds a value: neither null nor NaN."""
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) if df.schema[name].dataType.typeName() in ("float", "double") else c.isNotNull()


def _number(name: str) -> Column:
    """The column as a double, NaN as null."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def numeric_columns(df: DataFrame) -> DataFrame:
    """Only the columns of a numeric type."""
    return df.select(*numeric_names(df))


def column_info(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and number of non-null values."""
    counts = df.agg(*[F.count_if(_present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


def null_report(df: DataFrame) -> DataFrame:
    """Columns that hold nulls: how many and what percent of all rows, most first."""
    sums = [F.count_if(~_present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    counts = df.agg(F.count("*").alias("n"), *sums)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(df.columns)
    ]
    return (
        counts.select("n", F.inline(F.array(*entries)))
        .where(F.col("n_null") > 0)
        .select("column_name", "n_null", percent(F.col("n_null"), F.col("n")).alias("pct_null"))
        .orderBy(F.desc("pct_null"), "column_name")
    )


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """(keep..., feature, value) with one row per input row and column."""
    typed = df.select(*keep, *[(_number(c) if as_type == "double" else F.col(c).cast(as_type)).alias(c) for c in cols])
    return typed.unpivot(list(keep), list(cols), "feature", "value")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std (n-1), min, quartiles and max, one row per numeric column.

    ``approx=True`` takes the quartiles from a sketch in the same single pass.
    """
    cols = list(cols or numeric_names(df))
    if not cols:
        raise ValueError("no numeric columns")
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        v = _number(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"m{i}"),
            F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
        ]
        if approx:
            aggs.append(F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"))

    def entry(i: int, c: str) -> Column:
        fields = [
            F.lit(c).alias("feature"),
            F.col(f"n{i}").alias("n"),
            F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
        ]
        return F.struct(*fields, *([F.col(f"q{i}").alias("q")] if approx else []))

    stats = df.agg(*aggs).select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(cols)])))
    if not approx:
        q = grouped_quantiles(_long(df, cols), [0.25, 0.5, 0.75])
        by_feature = q.groupBy("feature").agg(
            F.map_from_entries(F.collect_list(F.struct("prob", "quantile"))).alias("_m")
        )
        stats = stats.join(by_feature, "feature", "left").withColumn(
            "q", F.array(*[F.try_element_at("_m", F.lit(p)) for p in (0.25, 0.5, 0.75)])
        )
    return stats.select(
        "feature", "n", "mean", "std", "min",
        F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"),
        "max",
    )


def group_count(df: DataFrame, keys: Sequence[str], dropna: bool = True) -> DataFrame:
    """Rows per seen key combination, in key order; rows with a null key are left out by default."""
    rows = df.dropna(subset=list(keys)) if dropna else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Count per value and its share of the non-null rows, most frequent first."""
    total = df.agg(F.count(F.col(col)).alias("n")).scalar()
    return _shares(df.where(F.col(col).isNotNull()), col, total)


def count_share_all(df: DataFrame, col: str) -> DataFrame:
    """As ``value_share``, but the share is of all rows, null ones included."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return _shares(df.where(F.col(col).isNotNull()), col, total)


def _shares(rows: DataFrame, col: str, total: Column) -> DataFrame:
    counted = rows.groupBy(col).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n").cast("double") / total).orderBy(F.desc("n"), col)


def feature_label_counts(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Rows per (feature, value, label), for all features in one pass."""
    long = _long(df, cols, [label], as_type="string").dropna(subset=["value", label])
    return long.groupBy("feature", "value", label).agg(F.count("*").alias("n"))


def class_value_share(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """For each feature and class: count of each value and its share of that class' non-null rows."""
    counted = feature_label_counts(df, cols, label)
    totals = counted.groupBy("feature", label).agg(F.sum("n").alias("_total"))
    joined = counted.join(totals, ["feature", label])
    return joined.select("feature", label, "value", "n", (F.col("n").cast("double") / F.col("_total")).alias("share"))


def crosstab(df: DataFrame, row: str, col: str, names: dict) -> DataFrame:
    """Rows per value of ``row``, one column for each value of ``col`` named in ``names``; absent pairs are 0."""
    counts = [F.count_if(F.col(col) == F.lit(v)).alias(name) for v, name in names.items()]
    return df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).agg(*counts)


def spearman_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rank correlation of every ordered column pair: (feature_x, feature_y, rho).

    Equal rows are folded to one counted row. Ranks come from the distinct values of all columns together, stored once,
    and the sums over the counted rows give the coefficients.
    Ranks are centred before they are multiplied, to keep digits on large tables. Pairs use the
    rows where both values are present; a column with one distinct value gives null.
    """
    cols = list(cols or numeric_names(df))
    if len(cols) < 2:
        raise ValueError("need two numeric columns")
    typed = df.select(*[_number(c).alias(c) for c in cols])
    counts = [F.count(F.col(c)).alias(c) for c in cols]
    sizes = typed.agg(*counts).first()
    folded = typed.groupBy(*cols).agg(F.count("*").alias("_c"))
    ranks = materialize(value_ranks(_long(df, cols), "value", "feature"), "value-ranks")
    ranked = folded
    for i, c in enumerate(cols):
        one = ranks.where(F.col("feature") == c).select(
            F.col("value").alias(c), (F.col("avg_rank") - (sizes[c] + 1) / 2).alias(f"_r{i}")
        )
        ranked = ranked.join(one, c, "left")
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                F.col(f"_r{i}").alias("x"), F.col(f"_r{j}").alias("y"),
            )
            for i, a in enumerate(cols)
            for j, b in enumerate(cols)
            if i <= j
        ]
    )
    w, x, y = F.col("_c").cast("double"), F.col("x"), F.col("y")
    upper = (
        ranked.select("_c", F.inline(pairs))
        .where(x.isNotNull() & y.isNotNull())
        .groupBy("feature_x", "feature_y")
        .agg(
            F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
            F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
        )
    )
    cov = F.expr("n * sxy - sx * sy")
    spread = F.sqrt(F.expr("n * sxx - sx * sx")) * F.sqrt(F.expr("n * syy - sy * sy"))
    half = upper.select("feature_x", "feature_y", F.try_divide(cov, spread).alias("rho"))
    # Mirror the upper triangle without computing it twice.
    both = F.array(
        F.struct(F.col("feature_x").alias("a"), F.col("feature_y").alias("b")),
        F.struct(F.col("feature_y").alias("a"), F.col("feature_x").alias("b")),
    )
    return half.select(F.explode(F.array_distinct(both)).alias("p"), "rho").select(
        F.col("p.a").alias("feature_x"), F.col("p.b").alias("feature_y"), "rho"
    )


def high_corr_pairs(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Column pairs whose rank correlation is above the threshold in absolute value, each pair once."""
    rho = spearman_matrix(df, cols)
    return rho.where((F.col("feature_x") < F.col("feature_y")) & (F.abs("rho") > threshold))


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of the tables, matched by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
