"""Gaussian naive Bayes with variance smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import ExpressionModel, binary_label, whole


def fit_bayes(df: DataFrame, features: Sequence[str], label: str, *, var_smoothing: float = 1e-9) -> ExpressionModel:
    """Class means and variances from one aggregate; ``var_smoothing`` times the largest overall variance is added.

    The model is the difference of the two class log likelihoods as a column expression.
    """
    features = list(features)
    sound = [whole(F.col(c).cast("double"), features) for c in features]
    wanted = [F.struct(F.avg(x).alias("m"), F.var_pop(x).alias("v")).alias(f"f{i}") for i, x in enumerate(sound)]
    # The extra grouping set gives the variances over all rows without a second scan.
    rows = (
        df.withColumn("_k", binary_label(label))
        .rollup(F.col("_k").alias("k"))
        .agg(F.count("*").alias("n"), *wanted)
        .collect()
    )
    by_class = {r["k"]: r for r in rows}
    if not {0, 1} <= set(by_class):
        raise ValueError("both classes are needed")
    total = by_class[None]
    extra = var_smoothing * max(total[f"f{i}"]["v"] for i in range(len(features)))

    def log_likelihood(k: int):
        r = by_class[k]
        out = F.lit(math.log(r["n"] / total["n"]))
        for i, c in enumerate(features):
            m, v = r[f"f{i}"]["m"], r[f"f{i}"]["v"] + extra
            off = F.col(c).cast("double") - F.lit(m)
            out = out - F.lit(0.5 * math.log(2 * math.pi * v)) - F.lit(0.5) * off * off / F.lit(v)
        return out

    return ExpressionModel(features, log_likelihood(1) - log_likelihood(0))
