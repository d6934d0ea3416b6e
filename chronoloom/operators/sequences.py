"""An epoch of a snapshot model: windows of snapshots one after another, with the recurrent
state of each node handed from window to window.

Messages are passed by Spark for all snapshots of a window at once; a node's snapshots of
the window then meet in one row, and a batch of rows is folded, and in training unrolled
backwards, as one pass. The gradient of the first convolution goes back along the edges by
message passing with their ends exchanged. A window is the span that gradients reach
through; its length bounds a row."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import gradients as gr
from chronoloom.functions.gradients import Weights
from chronoloom.operators import learning as ln
from chronoloom.operators import messages as ms
from chronoloom.operators.messages import vectors
from chronoloom.scratch import discard, materialise, shared_folder

_OUT = "node long, snap long, pred double, label double, state array<double>, back array<double>, i int, g double"


@dataclass(frozen=True)
class Cell:
    """One step over a node's snapshots: (inputs, states, weights) -> (states, kept), its
    backward pass, the widths of input and state, and where the output stands in it."""

    step: Callable
    back: Callable
    inputs: int
    state: int
    hidden: slice


def _lstms(x, s, w):
    d = s.shape[1] // 4
    (h1, c1), one = gr.lstm(x, s[:, :d], s[:, d : 2 * d], gr.part(w, "first"))
    (h2, c2), two = gr.lstm(h1, s[:, 2 * d : 3 * d], s[:, 3 * d :], gr.part(w, "second"))
    return np.concatenate([h1, c1, h2, c2], axis=1), (one, two)


def _lstms_back(ds, kept, w, g):
    d = ds.shape[1] // 4
    g1, g2 = gr.zeros(gr.part(w, "first")), gr.zeros(gr.part(w, "second"))
    dh1, dh2, dc2 = gr.lstm_back(ds[:, 2 * d : 3 * d], ds[:, 3 * d :], kept[1], gr.part(w, "second"), g2)
    dx, dh, dc = gr.lstm_back(ds[:, :d] + dh1, ds[:, d : 2 * d], kept[0], gr.part(w, "first"), g1)
    for k, v in (gr.within(g1, "first") | gr.within(g2, "second")).items():
        g[k] += v
    return dx, np.concatenate([dh, dc, dh2, dc2], axis=1)


def cell_of(model: str, d: int) -> Cell:
    if model in ("tgcn", "gcn"):
        return Cell(gr.tgcn, gr.tgcn_back, 3 * d, d, slice(0, d))
    if model == "mpnn_lstm":
        return Cell(_lstms, _lstms_back, d, 4 * d, slice(2 * d, 3 * d))
    if model == "evolvegcn":  # the matrix evolves, nodes keep nothing
        return Cell(lambda x, s, w: (x, None), lambda ds, kept, w, g: (ds, np.zeros_like(ds)), d, d, slice(0, d))
    raise KeyError(f"no snapshot model {model}")


def initial_weights(model: str, d: int, features: int, seed: int) -> Weights:
    """Uniform within one over the root of the number of inputs."""
    rng = np.random.default_rng(seed)
    one = lambda a, b: rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
    out = {"w": one(d, 1), "b": np.zeros(1)}
    if model == "evolvegcn":
        gates = {**{k: one(features + d, d) for k in "zrh"}, **{f"b{k}": np.zeros(d) for k in "zrh"}}
        return gr.flattened({"start": one(features, d), "pool": one(features, features), "bpool": np.zeros(features), "evolve": gates, "out": out})
    if model == "mpnn_lstm":
        cell = {k: {"wi": one(d, 4 * d), "wh": one(d, 4 * d), "bi": np.zeros(4 * d), "bh": np.zeros(4 * d)} for k in ("first", "second")}
    else:
        cell = {**{k: one(2 * d, d) for k in "urc"}, **{f"b{k}": np.zeros(d) for k in "urc"}}
    width = cell_of(model, d).inputs
    return gr.flattened({"gcn": [one(features, width), one(width, width)], "cell": cell, "out": out})


def sequence_pass(x: np.ndarray, label: np.ndarray, state: np.ndarray, weights: Weights, cell: Cell, train: bool):
    """(predictions, last states, loss, gradient, gradient of x) of inputs (rows, snapshots,
    width) and labels (rows, snapshots)."""
    own = gr.part(weights, "cell")
    second = weights.get("gcn.1")
    kept, preds, hidden = [], np.zeros(label.shape), []
    for t in range(label.shape[1]):
        inputs = x[:, t] @ second if second is not None else x[:, t]
        state, k = cell.step(inputs, state, own)
        kept.append(k)
        hidden.append(state[:, cell.hidden])
        preds[:, t] = (hidden[-1] @ weights["out.w"] + weights["out.b"])[:, 0]
    loss = float(((preds - label) ** 2).sum())
    if not train:
        return preds, state, loss, None, None
    g = gr.zeros({k: v for k, v in weights.items() if k.startswith(("out.", "cell.")) or k == "gcn.1"})
    gc, dx = gr.zeros(own), np.zeros_like(x)
    ds = np.zeros_like(state)
    for t in range(label.shape[1] - 1, -1, -1):
        dp = 2 * (preds[:, t] - label[:, t])[:, None]
        g["out.w"] += hidden[t].T @ dp
        g["out.b"] += dp.sum(axis=0)
        ds[:, cell.hidden] += dp @ weights["out.w"].T
        d_in, ds = cell.back(ds, kept[t], own, gc)
        if second is not None:
            g["gcn.1"] += x[:, t].T @ d_in
            d_in = d_in @ second.T
        dx[:, t] = d_in
    return preds, state, loss, g | gr.within(gc, "cell"), dx


def window_rows(inputs: DataFrame, labels: DataFrame, nodes: DataFrame, low: int, high: int, start: DataFrame | None, weights: Weights, cell: Cell, train: bool) -> DataFrame:
    """Predictions of all nodes in snapshots low .. high - 1, with the state after the last
    one; in training also the gradient of each input row and the tasks' parts."""
    width = weights["gcn.1"].shape[0] if "gcn.1" in weights else cell.inputs
    span = F.col("snap").between(low, high - 1)
    both = inputs.where(span).select("node", "snap", "feat").join(labels.where(span).select("node", "snap", "label"), ["node", "snap"], "full")
    # a window's snapshots bound a row
    series = both.groupBy("node").agg(F.collect_list(F.struct((F.col("snap") - low).cast("int").alias("t"), "feat", "label")).alias("s"))
    rows = nodes.select("node").join(series, "node", "left")
    rows = rows.withColumn("state", F.lit(None).cast("array<double>")) if start is None else rows.join(start, "node", "left")
    steps, names = high - low, [c.split(" ")[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, terms, g = 0.0, 0, None
        for b in batches:
            n = len(b)
            if not n:
                continue
            x, label, state = np.zeros((n, steps, width)), np.zeros((n, steps)), np.zeros((n, cell.state))
            some = np.zeros((n, steps), dtype=bool)
            series = b.column("s")
            count = np.diff(np.asarray(series.offsets, dtype=np.int64))
            flat, row = series.flatten(), np.repeat(np.arange(n), count)
            t = flat.field("t").to_numpy(zero_copy_only=False).astype(np.int64)
            feat = flat.field("feat")
            known = np.flatnonzero(feat.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                x[row[known], t[known]] = feat.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(known), width)
                some[row[known], t[known]] = True
            label[row, t] = flat.field("label").fill_null(0.0).to_numpy(zero_copy_only=False)
            before = np.flatnonzero(b.column("state").is_valid().to_numpy(zero_copy_only=False))
            if len(before):
                state[before] = b.column("state").drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(before), cell.state)
            preds, state, loss, own, dx = sequence_pass(x, label, state, weights, cell, train)
            total, terms = total + loss, terms + label.size
            if own is not None:
                g = own if g is None else {k: v + own[k] for k, v in g.items()}
            last = np.tile(np.arange(steps) == steps - 1, n)
            states = pa.array([None] * (n * steps), pa.list_(pa.float64())) if not steps else _where(np.repeat(state, steps, axis=0), last)
            backs = _where(dx.reshape(n * steps, width), some.ravel()) if dx is not None else pa.nulls(n * steps, pa.list_(pa.float64()))
            nodes_ = b.column("node").take(pa.array(np.repeat(np.arange(n), steps)))
            yield pa.RecordBatch.from_arrays([nodes_, pa.array(np.tile(np.arange(low, high), n)), pa.array(preds.ravel()), pa.array(label.ravel()), states, backs, *ln.no_part(n * steps)], names=names)
        if g is not None:
            i, values = ln.part_of(total, terms, g)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(i), k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))), pa.array(i), pa.array(values)], names=names)

    return rows.mapInArrow(run, _OUT)


def _where(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, null where told so."""
    size = np.where(some, rows.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(rows[some].ravel()), mask=pa.array(~some))


def first_layer(aggregated: DataFrame, weights: Weights) -> DataFrame:
    """(snap, node, feat): relu of the first map of summed messages."""
    return aggregated.select("snap", "node", ms.relu(ms.linear(F.col("feat"), weights["gcn.0"])).alias("feat"))


def first_layer_gradient(aggregated: DataFrame, edges: DataFrame, back: DataFrame, weights: Weights) -> tuple[DataFrame, Weights]:
    """The tasks' parts of the gradient of the first map: gradients of the second layer's
    sums go back along the edges."""
    turned = edges.select("snap", F.col("dst").alias("src"), F.col("src").alias("dst"), "norm")
    arrived = ms.propagate_vectors(turned, back.select("snap", "node", F.col("back").alias("feat")), by=["snap"], width=weights["gcn.0"].shape[1])
    rows = aggregated.join(arrived.withColumnRenamed("feat", "d"), ["snap", "node"]).select("feat", "d")
    w = weights["gcn.0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros_like(w)
        for b in batches:
            if len(b):
                x = b.column("feat").flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(w))
                d = b.column("d").flatten().to_numpy(zero_copy_only=False).reshape(len(b), w.shape[1])
                g += x.T @ (d * (x @ w > 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size, dtype=np.int32)), pa.array(g.ravel())], names=["i", "g"])

    return rows.mapInArrow(run, "i int, g double"), {"gcn.0": w}


def sequence_epoch(edges: DataFrame, features: DataFrame, labels: DataFrame, nodes: DataFrame, low: int, high: int, window: int, start, weights: Weights, model: str, optimiser: ln.Adam | None = None, aggregated: DataFrame | None = None):
    """((node, snap, pred, label), state, weights, losses) of snapshots low .. high - 1.
    ``start`` is the state that an earlier span ended with: a table (node, state), or for
    evolvegcn its matrix. aggregated: summed messages of the features, if they are known."""
    spark = nodes.sparkSession
    d = len(weights["out.w"])
    cell = cell_of(model, d)
    folder = f"{shared_folder(spark)}/sequence-{uuid.uuid4().hex}"
    losses, state = [], start
    if model != "evolvegcn" and aggregated is None:
        span = F.col("snap").between(low, high - 1)
        aggregated = materialise(ms.propagate_vectors(edges.where(span), features.where(span), by=["snap"], width=len(weights["gcn.0"])))
    for at in range(low, high, window):
        end = min(high, at + window)
        span = F.col("snap").between(at, end - 1)
        if model == "evolvegcn":
            own = {"start": state if state is not None else weights["start"], "pool": weights["pool"], "bpool": weights["bpool"], "cell": gr.part(weights, "evolve")}
            evolved = ms.evolved_matrices(features.where(span), own, nodes.count())
            inputs = ms.with_matrices(edges.where(span), features.where(span), evolved)
            state = evolved[-1][1] if evolved else state
        else:
            inputs = ms.propagate_vectors(edges.where(span), first_layer(aggregated.where(span), weights), by=["snap"], width=weights["gcn.0"].shape[1])
        rows = window_rows(inputs, labels, nodes, at, end, state if model != "evolvegcn" else None, weights, cell, optimiser is not None)
        path = f"{folder}/window={at}"
        rows.write.parquet(path)
        rows = spark.read.schema(_OUT).parquet(path)
        if model != "evolvegcn":
            carried = materialise(rows.where((F.col("snap") == end - 1) & F.col("state").isNotNull()).select("node", "state"))
            if state is not None and state is not start:
                discard(state)
            state = carried
        if optimiser is not None:
            like = {k: v for k, v in weights.items() if k.startswith(("out.", "cell.")) or k == "gcn.1"}
            loss, g = ln.summed(rows, like)
            if model != "evolvegcn":
                parts, one = first_layer_gradient(aggregated.where(span), edges.where(span), rows.where("back is not null"), weights)
                terms = rows.where("i = -2").agg(F.sum("g")).first()[0]
                values = parts.groupBy("i").agg(F.sum(F.col("g").cast("decimal(38,18)")).cast("double").alias("g")).orderBy("i").collect()
                if values and terms:
                    g |= gr.unpacked(np.array([v["g"] for v in values]) / terms, one)
            weights = optimiser.step(weights, g)
            losses.append(loss)
    found = spark.read.parquet(folder) if high > low else spark.createDataFrame([], _OUT)
    return found.where("node is not null").select("node", "snap", "pred", "label"), state, weights, losses
