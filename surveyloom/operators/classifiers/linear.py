"""Linear margins: logistic regression, support vector machines, discriminant analysis."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers import newton
from surveyloom.operators.classifiers.base import (
    VECTOR,
    WEIGHT,
    ExpressionModel,
    Scaler,
    binary_label,
    fit_pipeline,
    fold_rows,
    scaled,
    whole,
)
from surveyloom.session import discard


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    C: float = 1.0,
    penalty: str | None = "l2",
    l1_ratio: float = 0.5,
    fit_intercept: bool = True,
    max_iter: int = 100,
) -> ExpressionModel:
    """Logistic regression: the sum of the log losses plus the penalty of strength 1 / ``C``, by Newton steps."""
    one = newton.problem(C, penalty, l1_ratio, fit_intercept)
    features = list(features)
    counted = newton.counted_rows(df, features, label)
    weights = newton.solve(counted, len(features), [one], max_iter)[0]
    discard(counted)
    margin = F.lit(float(weights[-1]))
    for c, w in zip(features, weights):
        margin = margin + F.col(c).cast("double") * F.lit(float(w))
    return ExpressionModel(features, margin, detail={"coef": weights[:-1], "intercept": float(weights[-1])})


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


def cubic(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return (gamma * x @ y.T) ** 3


KERNELS = {"rbf": rbf, "poly": cubic}


class KernelModel:
    """Linear margin on the Nystroem features of the scaled inputs: inner products of these approach the kernel.

    ``detail`` states how well: the largest and the root mean square difference to the kernel, over pairs of training rows that are no landmarks.
    """

    def __init__(self, features, scaler: Scaler, kernel: str, gamma: float, landmarks: np.ndarray):
        self.features, self.scaler, self.kernel, self.gamma, self.landmarks = list(features), scaler, kernel, gamma, landmarks
        values, vectors = np.linalg.eigh(KERNELS[kernel](landmarks, landmarks, gamma))
        kept = values > 1e-10 * values.max()
        self.root = vectors[:, kept] / np.sqrt(values[kept])
        self.svm, self.detail = None, {}

    def map(self, x: np.ndarray) -> np.ndarray:
        return KERNELS[self.kernel](x, self.landmarks, self.gamma) @ self.root

    def measure(self, rows: np.ndarray) -> None:
        half = len(rows) // 2
        if half:
            off = self.map(rows[:half]) @ self.map(rows[half : 2 * half]).T - KERNELS[self.kernel](rows[:half], rows[half : 2 * half], self.gamma)
            self.detail = {"pairs": off.size, "largest_error": float(np.abs(off).max()), "rms_error": float(np.sqrt((off**2).mean()))}

    def project(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((self.kernel, self.gamma, self.landmarks, self.root))  # landmarks squared

        @F.pandas_udf("array<double>")
        def features(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            kernel, gamma, landmarks, root = sent.value
            for cols in batches:
                x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
                yield pd.Series(list(KERNELS[kernel](x, landmarks, gamma) @ root))

        inputs = [whole(F.col(scaled(c)), self.features) for c in self.features]
        return self.scaler.apply(df).withColumn(VECTOR, array_to_vector(features(*inputs)))

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.svm.transform(self.project(df))
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
        return out.withColumn("probability", 1 / (1 + F.exp(-margin))).select(*df.columns, "prediction", "probability")


def fit_svm(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    C: float = 1.0,
    kernel: str = "linear",
    gamma: float | str = "scale",
    landmarks: int = 256,
    checked: int = 200,
    max_iter: int = 50,
    seed: int = 1,
):
    """Support vector machine on scaled features.

    'linear' is direct; 'rbf' and 'poly' (degree 3) go through Nystroem features of ``landmarks`` rows, those of the smallest hash among the distinct
    rows. ``checked`` further rows measure how well these stand for the kernel.
    """
    train, n = fold_rows(df, features, label)
    svm = LinearSVC(
        featuresCol=VECTOR,
        labelCol=label,
        weightCol=WEIGHT,
        regParam=1.0 / (float(C) * max(1, n)),
        maxIter=max_iter,
        standardization=False,
    )
    scaler = Scaler.fit(df, features)
    if kernel == "linear":
        return fit_pipeline(train, features, svm, scaler=scaler)
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel} is not available")
    width = 1.0 / len(features) if gamma in ("scale", "auto") else float(gamma)
    draw = F.xxhash64(F.lit(seed), *[F.col(c).cast("double") for c in features])
    distinct = scaler.apply(train.select(*features).distinct()).select(draw.alias("_draw"), *[scaled(c) for c in features])
    drawn = distinct.orderBy("_draw").limit(landmarks + checked).collect()
    points = np.array([r[1:] for r in drawn], float).reshape(-1, len(features))
    if not len(points):
        raise ValueError("no training rows")
    model = KernelModel(features, scaler, kernel, width, points[:landmarks])
    model.measure(points[landmarks:])
    model.svm = svm.fit(model.project(train))
    return model


def fit_discriminant(
    df: DataFrame, features: Sequence[str], label: str, *, solver: str = "lsqr", shrinkage: float | None = None
) -> ExpressionModel:
    """Linear discriminant analysis of two classes on scaled features.

    Class means and the pooled covariance come from one aggregate each; only d x d numbers reach the
    driver, where the discriminant is solved. All solvers give the same discriminant here.
    """
    if solver == "svd" and shrinkage:
        raise ValueError("the svd solver takes no shrinkage")
    features = list(features)
    scaler = Scaler.fit(df, features)
    names = [scaled(c) for c in features]
    x = scaler.apply(df).withColumn(label, binary_label(label)).withColumns({c: whole(F.col(c), features) for c in names})
    rows = x.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).collect()
    stats = {int(r[label]): (r["n"], np.array([r[c] for c in names], dtype=float)) for r in rows}
    if set(stats) != {0, 1}:
        raise ValueError("both classes are needed")
    (n0, m0), (n1, m1) = stats[0], stats[1]
    n, d = n0 + n1, len(names)

    def centred(i: int):
        return F.col(names[i]) - F.when(F.col(label) == 1, F.lit(float(m1[i]))).otherwise(F.lit(float(m0[i])))

    sums = [F.sum(centred(i) * centred(j)) for i in range(d) for j in range(i, d)]
    flat = list(x.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first())
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = np.array(flat, dtype=float) / n
    cov = cov + np.triu(cov, 1).T
    lam = float(shrinkage or 0.0)
    cov = (1 - lam) * cov + lam * np.trace(cov) / d * np.eye(d)
    w = np.linalg.pinv(cov) @ (m1 - m0)
    b = -0.5 * float((m0 + m1) @ w) + math.log(n1 / n0)
    margin = F.lit(b)
    for c, coef in zip(names, w):
        margin = margin + F.col(c) * F.lit(float(coef))
    return ExpressionModel(features, margin, scaler=scaler, detail={"coef": w, "intercept": b})
