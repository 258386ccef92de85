"""The common shape of a fitted classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.encoding import column_moments, standard_score

VECTOR = "_features"


@dataclass
class Scaler:
    """Standard scores with the moments of the training rows."""

    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Scaler:
        return cls(column_moments(df, features))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({scaled(c): standard_score(c, *m) for c, m in self.moments.items()})


def scaled(col: str) -> str:
    return f"_std_{col}"


WEIGHT = "_weight"


def fold_rows(df: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, int]:
    """Training rows with a weight column, and how many rows they stand for.

    Survey answers repeat, so equal rows become one weighted row and every later pass of an iterative fit reads
    the short table. This is for fits whose loss is a weighted sum over rows, which folding leaves as it is.
    """
    slim = df.select(*[whole(F.col(c).cast("double"), features).alias(c) for c in features], binary_label(label).cast("double").alias(label))
    return slim.groupBy(*slim.columns).agg(F.count("*").cast("double").alias(WEIGHT)), slim.count()


def binary_label(label: str) -> Column:
    """The label as 0 or 1; any other value, null too, makes the query fail."""
    y = F.col(label).cast("double")
    problem = F.concat(F.lit(f"{label} must be 0 or 1, not "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
    return F.when(y.isin(0.0, 1.0), y.cast("int")).otherwise(F.raise_error(problem).cast("int"))


def whole(value: Column, features: Sequence[str]) -> Column:
    """``value`` where no feature is missing (null or NaN); a row with a missing feature makes the query fail."""
    missing = F.lit(False)
    for c in features:
        x = F.col(c).cast("double")
        missing = missing | x.isNull() | F.isnan(x)
    problem = f"a feature of {list(features)} is missing"
    return F.when(missing, F.raise_error(F.lit(problem)).cast("double")).otherwise(value)


@dataclass
class ExpressionModel:
    """A model whose margin is a column expression: scoring is one projection inside generated code.

    Rows with a missing feature cannot be scored; fill or drop them first.
    """

    features: list[str]
    margin: Column
    threshold: float = 0.0
    scaler: Scaler | None = None
    detail: dict[str, Any] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        scored = (self.scaler.apply(df) if self.scaler else df).withColumn("_margin", whole(self.margin, self.features))
        out = scored.withColumn("prediction", F.when(F.col("_margin") > self.threshold, 1.0).otherwise(0.0))
        out = out.withColumn("probability", 1 / (1 + F.exp(-F.col("_margin"))))
        return out.select(*df.columns, "prediction", "probability")


@dataclass
class PipelineClassifier:
    """A fitted Spark ML pipeline behind the common ``predict``."""

    features: list[str]
    pipeline: PipelineModel
    scaler: Scaler | None = None
    saved: str | None = None  # folder of the saved last stage, once something has asked for its table

    @property
    def stage(self) -> Transformer:
        return self.pipeline.stages[-1]

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(self.scaler.apply(df) if self.scaler else df)
        if "probability" in scored.columns:
            positive = F.get(vector_to_array("probability"), F.lit(1))
        else:
            positive = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
        return scored.withColumn("_p", positive).select(
            *df.columns, "prediction", F.col("_p").alias("probability")
        )


def fit_pipeline(
    df: DataFrame,
    features: Sequence[str],
    estimator,
    scale: bool = False,
    before: Sequence = (),
    scaler: Scaler | None = None,
) -> PipelineClassifier:
    """Assemble the features, optionally scaled, run the given stages and fit the estimator."""
    features = list(features)
    if scaler is None and scale:
        scaler = Scaler.fit(df, features)
    names = [scaled(c) for c in features] if scaler else features
    stages = [VectorAssembler(inputCols=names, outputCol=VECTOR), *before, estimator]
    train = scaler.apply(df) if scaler else df
    fitted = Pipeline(stages=stages).fit(train)
    return PipelineClassifier(features, fitted, scaler)
