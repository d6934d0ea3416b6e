"""Tasks and models by name: which loss, metrics and output go with a prediction table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import metrics as mt
from chronoloom.operators import messages as ms


@dataclass(frozen=True)
class Task:
    """loss and metrics take a prediction table and return one row; output is what a
    caller keeps of it."""

    loss: Callable[[DataFrame], DataFrame]
    metrics: Callable[[DataFrame], DataFrame]
    output: Callable[[DataFrame], DataFrame]


def _beside(*tables: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(F.broadcast(t))
    return out


def vector_width(rows: DataFrame, column: str = "feat") -> int:
    """The one length of a vector column; an error where lengths differ."""
    low, high = rows.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low is None or low != high:
        raise ValueError(f"vectors of {column} have lengths from {low} to {high}")
    return low


def labels_of(rows: DataFrame, names: tuple[str, ...] = ("label", "y", "target")) -> DataFrame:
    """(node, snap, label) by the first of the names that the table has, cast to double."""
    found = next((n for n in names if n in rows.columns), None)
    if found is None:
        raise ValueError(f"no label column among {', '.join(names)}")
    keys = [c for c in ("node", "snap") if c in rows.columns]
    return rows.select(*keys, F.col(found).cast("double").alias("label"))


def _link_output(scores: DataFrame) -> DataFrame:
    return scores.select("eid", mt.sigmoid(F.col("score")).alias("probability"), "label")


def _class_output(rows: DataFrame) -> DataFrame:
    return rows.select("node", mt.argmax(F.col("logits")).alias("predicted"), "label")


TASKS: dict[str, Task] = {
    "temporal_link_prediction": Task(mt.bce, lambda s: _beside(mt.auc(s), mt.average_precision(s), mt.pseudo_ap(s)), _link_output),
    "node_regression": Task(mt.mse, mt.regression, lambda p: p.select("node", "pred", "label")),
    "node_classify": Task(mt.cross_entropy, mt.accuracy, _class_output),
}

#: The snapshot models by name, and one attention model under the names it is known by.
MODELS: dict[str, Callable] = {"gcn": ms.tgcn, "tgcn": ms.tgcn, "mpnn_lstm": ms.mpnn_lstm, "evolvegcn": ms.evolvegcn}
MODELS |= {name: ms.temporal_attention for name in ("tgn", "jodie", "dyrep", "tgat", "apan")}


def task(name: str) -> Task:
    if name not in TASKS:
        raise KeyError(f"unknown task {name}; there are {', '.join(sorted(TASKS))}")
    return TASKS[name]


def register_task(name: str, value: Task) -> None:
    TASKS[name] = value


def model(name: str) -> Callable:
    if name not in MODELS:
        raise KeyError(f"unknown model {name}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name]
