"""Gradients summed over the cluster, and the steps that weights take.

Tasks return their part of the gradient as rows (i, g), one for each weight, -1 for the
loss and -2 for the number of terms; Spark sums them as decimals, so that the result does
not depend on the order in which tasks end. What reaches the driver has the size of the
weights, however many rows the gradient is of."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.gradients import Weights, packed, unpacked, zeros

LOSS, TERMS = -1, -2


def part_of(loss: float, terms: int, g: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The rows (i, g) of a task's part."""
    values = np.concatenate([[terms, loss], packed(g)])
    return np.arange(TERMS, len(values) + TERMS, dtype=np.int32), values


def summed(parts: DataFrame, like: Weights) -> tuple[float, Weights]:
    """Mean loss and gradient of all parts."""
    rows = parts.where("i is not null").groupBy("i").agg(F.sum(F.col("g").cast("decimal(38,18)")).cast("double").alias("g")).collect()
    found = {r["i"]: r["g"] for r in rows}
    terms = found.get(TERMS, 0.0)
    if not terms:
        return 0.0, zeros(like)
    values = np.array([found[i] for i in range(len(found) + TERMS)])
    return found[LOSS] / terms, unpacked(values / terms, like)


def no_part(n: int) -> list[pa.Array]:
    return [pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64())]


@dataclass
class Adam:
    """Steps with running means of the gradient and of its square. Its state is small
    arrays, saved and loaded with the weights, so that a resumed run goes on as the first."""

    rate: float = 0.01
    keep: tuple[float, float] = (0.9, 0.999)
    steps: int = 0
    mean: Weights = field(default_factory=dict)
    square: Weights = field(default_factory=dict)

    def step(self, weights: Weights, g: Weights) -> Weights:
        self.steps += 1
        a, b = self.keep
        out = dict(weights)
        for k, v in g.items():
            self.mean[k] = a * self.mean.get(k, np.zeros_like(v)) + (1 - a) * v
            self.square[k] = b * self.square.get(k, np.zeros_like(v)) + (1 - b) * v * v
            out[k] = weights[k] - self.rate * (self.mean[k] / (1 - a**self.steps)) / (np.sqrt(self.square[k] / (1 - b**self.steps)) + 1e-8)
        return out


def _rows(weights: Weights) -> list[tuple[str, list[int], list[float]]]:
    return [(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(weights.items())]


def weight_table(spark, weights: Weights, optimiser: Adam | None = None) -> DataFrame:
    """(kind, name, shape, data): weights, and the optimiser's state."""
    rows = [("weight", *r) for r in _rows(weights)]
    if optimiser is not None:
        rows += [("mean", *r) for r in _rows(optimiser.mean)] + [("square", *r) for r in _rows(optimiser.square)]
        rows.append(("steps", "", [], [float(optimiser.steps)]))
    return spark.createDataFrame(rows, "kind string, name string, shape array<int>, data array<double>").coalesce(1)


def from_weight_table(table: DataFrame, rate: float = 0.01) -> tuple[Weights, Adam]:
    found: dict[str, Weights] = {"weight": {}, "mean": {}, "square": {}}
    steps = 0
    for r in table.collect():
        if r["kind"] == "steps":
            steps = int(r["data"][0])
        else:
            found[r["kind"]][r["name"]] = np.array(r["data"]).reshape(r["shape"])
    return found["weight"], Adam(rate, steps=steps, mean=found["mean"], square=found["square"])
