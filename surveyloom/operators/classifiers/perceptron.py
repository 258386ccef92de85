"""Multi-layer perceptron: full-batch gradients added up over all tasks, Adam steps on the driver.

Equal rows are one counted row. A step is one pass: each task runs its rows forward and backward and sends the sums of loss and slope, which have
the size of the network.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.classifiers.base import Scaler, scaled, whole
from surveyloom.operators.classifiers.newton import counted_rows
from surveyloom.session import discard

#: Numbers in the widest layer that a task holds at once.
HELD = 4_000_000
# activation -> (value, slope from the value)
ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (lambda z: 0.5 * (1 + np.tanh(0.5 * z)), lambda a: a * (1 - a)),
}


@dataclass(frozen=True)
class Shape:
    """The layers of a network whose weights lie in one array: per layer the matrix, then the offsets."""

    sizes: tuple[int, ...]
    activation: str

    @property
    def layers(self) -> list[tuple[int, int]]:
        return list(zip(self.sizes, self.sizes[1:]))

    @property
    def length(self) -> int:
        return sum((a + 1) * b for a, b in self.layers)

    def split(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.layers:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def start(self, seed: int) -> np.ndarray:
        """Even draws whose width keeps the variance from layer to layer."""
        rng = np.random.default_rng(seed)
        factor = 2.0 if self.activation == "logistic" else 6.0
        return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) * np.sqrt(factor / (a + b)) for a, b in self.layers])

    def penalised(self) -> np.ndarray:
        """1 for the weights that the penalty counts, 0 for offsets."""
        return np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in self.layers])

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The values of all layers; the last is the margin."""
        act = ACTIVATIONS[self.activation][0]
        layers, values = self.split(flat), [x]
        for k, (w, b) in enumerate(layers):
            z = values[-1] @ w + b
            values.append(z if k == len(layers) - 1 else act(z))
        return values

    def loss_and_slope(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the log losses of counted rows, and its slope."""
        slope_of = ACTIVATIONS[self.activation][1]
        values = self.forward(flat, x)
        margin = values[-1][:, 0]
        loss = float((n * (np.logaddexp(0, margin) - y * margin)).sum())
        back = (n * (0.5 * (1 + np.tanh(0.5 * margin)) - y))[:, None]
        parts = []
        for (w, _), value in zip(reversed(self.split(flat)), reversed(values[:-1]), strict=True):
            parts.append(np.concatenate([(value.T @ back).ravel(), back.sum(axis=0)]))
            back = (back @ w.T) * slope_of(value)
        return loss, np.concatenate(parts[::-1])


def _sums(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, flat = sent.value
        out = np.zeros(1 + shape.length)
        step = max(1, HELD // max(shape.sizes))
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, step):
                _, y, *cols, n = (c.to_numpy(zero_copy_only=False) for c in whole_batch.slice(a, step).columns)
                loss, slope = shape.loss_and_slope(flat, np.column_stack(cols), y, n)
                out[0] += loss
                out[1:] += slope
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["place", "value"])

    return run


@dataclass
class Perceptron:
    features: list[str]
    scaler: Scaler
    shape: Shape
    weights: np.ndarray
    losses: list[float]

    def predict(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((self.shape, self.weights))

        @F.pandas_udf("double")
        def margins(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            shape, weights = sent.value
            for cols in batches:
                yield pd.Series(shape.forward(weights, np.column_stack([c.to_numpy(dtype=float) for c in cols]))[-1][:, 0])

        inputs = [whole(F.col(scaled(c)), self.features) for c in self.features]
        out = self.scaler.apply(df).withColumn("_margin", margins(*inputs))
        probability = 1 / (1 + F.exp(-F.col("_margin")))
        return out.select(*df.columns, F.when(F.col("_margin") > 0, 1.0).otherwise(0.0).alias("prediction"), probability.alias("probability"))


def fit_perceptron(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    hidden: Sequence[int] = (100,),
    activation: str = "relu",
    alpha: float = 1e-4,
    learning_rate: float = 0.02,
    schedule: str = "constant",
    max_iter: int = 1000,
    tolerance: float = 1e-4,
    patience: int = 10,
    seed: int = 1,
) -> Perceptron:
    """A perceptron on scaled features: mean log loss plus ``alpha`` / 2n times the squared weights.

    When the loss has not fallen by ``tolerance`` for ``patience`` steps, the fit ends; with the schedule 'adaptive' the rate
    is first divided by five, down to a millionth.
    """
    if activation not in ACTIVATIONS or schedule not in ("constant", "adaptive"):
        raise ValueError(f"unknown activation {activation} or schedule {schedule}")
    features = list(features)
    scaler = Scaler.fit(df, features)
    inputs = scaler.apply(df.select(*[whole(F.col(c).cast("double"), features).alias(c) for c in features], label))
    rows = counted_rows(inputs, [scaled(c) for c in features], label)
    spark = df.sparkSession
    total = rows.agg(F.sum("_n")).first()[0]
    if not total:
        raise ValueError("no training rows")
    shape = Shape((len(features), *[int(h) for h in hidden], 1), activation)
    flat, penalised = shape.start(seed), shape.penalised()
    first, second, losses, best, stalled, rate = np.zeros(shape.length), np.zeros(shape.length), [], np.inf, 0, float(learning_rate)
    for step in range(1, max_iter + 1):
        sent = spark.sparkContext.broadcast((shape, flat))
        sums = np.zeros(1 + shape.length)
        table = rows.mapInArrow(_sums(sent), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()  # the size of the network
        sums[table.column("place").to_numpy()] = table.column("value").to_numpy()
        sent.unpersist()
        loss = (sums[0] + 0.5 * alpha * float((penalised * flat) @ flat)) / total
        slope = (sums[1:] + alpha * penalised * flat) / total
        losses.append(float(loss))
        stalled = 0 if loss < best - tolerance else stalled + 1
        best = min(best, loss)
        if stalled >= patience:
            if schedule == "constant" or rate < 5e-6:
                break
            rate, stalled = rate / 5, 0
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    discard(rows)
    return Perceptron(features, scaler, shape, flat, losses)
