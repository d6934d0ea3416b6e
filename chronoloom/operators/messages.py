"""Message passing, attention and recurrent folds over snapshots.

Vectors are arrays of doubles; learned weights are small and go in as literals or to
Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import gradients as gr
from chronoloom.operators.events import HOT_FROM
from chronoloom.scratch import bucketed, discard, materialise


def propagate(edges: DataFrame, value: str = "value", norm: str = "norm", by: list[str] | None = None) -> DataFrame:
    """(by, node, value): sum over in-edges of norm * value of the source; ``edges`` has
    the source's value already."""
    return edges.groupBy(*(by or []), F.col("dst").alias("node")).agg(F.sum(F.col(norm) * F.col(value)).alias("value"))


#: Entries of a feature table that are broadcast at once (64 MB).
SMALL_ENTRIES = 8_000_000
#: What a row takes besides its vector, in entries.
ROW_ENTRIES = 6
#: Entries of sums, or of edges, of a task.
TASK_ENTRIES = 4_000_000


def vector_parts(edges: DataFrame, features: DataFrame, norm: str = "norm", by: list[str] | None = None, width: int | None = None, hot_from: int = HOT_FROM) -> list[tuple[int, DataFrame]]:
    """(first component, (by, node, feat)) of message passing on vectors; a node stands in
    a part if a vector that it gets has components there. Each component is a sum of its
    own in one row for each node. width: entries of the longest vector, if it is known,
    which makes one part by a shuffled join. If not, features are counted and sent to the
    edges, as many components at once as make up ``SMALL_ENTRIES``: no vector is shuffled
    with an edge. Edges are shuffled by their target, for several parts once, into a
    table's buckets; those of targets with ``hot_from`` edges and more are summed in parts
    before they are shuffled. Only more than ``SMALL_ENTRIES`` vectors are joined by a
    shuffle."""
    by = by or []
    own = features.withColumnRenamed("node", "src")

    def summed(rows: DataFrame, own: DataFrame, width: int) -> DataFrame:
        joined = rows.join(own, [*by, "src"]).where(F.size("feat") > 0)
        sums = [F.sum(F.col(norm) * F.get("feat", F.lit(i))).alias(f"_{i}") for i in range(width)]
        found = joined.groupBy(*by, F.col("dst").alias("node")).agg(F.max(F.size("feat")).alias("_n"), *sums)
        return found.select(*by, "node", F.slice(F.array(*[F.col(f"_{i}") for i in range(width)]).cast("array<double>"), 1, F.col("_n")).alias("feat"))

    if width is not None:
        return [(0, summed(edges, own, width))]
    width, vectors = features.agg(F.max(F.size("feat")), F.count("*")).first()
    width = max(0, width or 0)
    if vectors > SMALL_ENTRIES:
        return [(0, summed(edges, own, width))]
    step = width if width * vectors <= SMALL_ENTRIES else max(1, SMALL_ENTRIES // vectors - ROW_ENTRIES)
    edges = edges.select(*by, "src", "dst", norm)
    sizes = materialise(edges.groupBy(*by, "dst").agg(F.count("*").alias("_n")))
    targets, rows, hot = sizes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col("_n") >= hot_from)).first()
    cold, warm = edges, None
    if hot:
        # few, as each has so many edges
        frequent = F.broadcast(sizes.where(F.col("_n") >= hot_from).select(*by, "dst"))
        cold, warm = edges.join(frequent, [*by, "dst"], "left_anti"), edges.join(frequent, [*by, "dst"], "left_semi")
    usual = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, -(-targets * (step + ROW_ENTRIES) // TASK_ENTRIES), -(-rows * ROW_ENTRIES // TASK_ENTRIES))

    def part(cold: DataFrame, warm: DataFrame | None, own: DataFrame, width: int) -> DataFrame:
        found = summed(cold, F.broadcast(own), width)
        return found if warm is None else found.unionByName(summed(warm, F.broadcast(own), width))

    if step == width:
        cold = cold.repartition(tasks, *by, "dst") if tasks > usual else cold.repartition(*by, "dst")
        return [(0, part(cold, warm, own, width))]
    cold, warm = bucketed(cold, tasks, [*by, "dst"], "src"), warm if warm is None else materialise(warm)
    parts = []
    for at in range(0, width, step):  # one after another, so that one broadcast is held
        some = own.withColumn("feat", F.slice("feat", at + 1, step))
        parts.append((at, materialise(part(cold, warm, some, min(step, width - at)))))
    discard(sizes, cold, *([] if warm is None else [warm]))
    return parts


def propagate_vectors(edges: DataFrame, features: DataFrame, norm: str = "norm", by: list[str] | None = None, width: int | None = None, hot_from: int = HOT_FROM) -> DataFrame:
    """(by, node, feat): ``propagate`` for vectors, as ``vector_parts`` does it."""
    by, parts = by or [], vector_parts(edges, features, norm, by, width, hot_from)
    if len(parts) == 1:
        return parts[0][1]
    rows = reduce(DataFrame.unionByName, [p.withColumn("at", F.lit(at)) for at, p in parts])
    return rows.groupBy(*by, "node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "feat"))), lambda s: s["feat"])).alias("feat"))


def propagate_entries(edges: DataFrame, features: DataFrame, norm: str = "norm", by: list[str] | None = None, hot_from: int = HOT_FROM) -> DataFrame:
    """(by, node, i, x): the components of ``propagate_vectors`` as rows; parts are not joined."""
    parts = vector_parts(edges, features, norm, by, None, hot_from)
    rows = [p.select(*(by or []), "node", F.posexplode("feat").alias("i", "x")).withColumn("i", F.col("i") + at) for at, p in parts]
    return reduce(DataFrame.unionByName, rows)


def linear(vector: Column, matrix: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """vector @ matrix + bias, for small fixed matrices."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in col]) for col in np.asarray(matrix).T])
    dot = lambda col: F.aggregate(F.zip_with(vector, col, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = F.transform(rows, dot)
    return out if bias is None else F.zip_with(out, F.array(*[F.lit(float(v)) for v in bias]), lambda a, b: a + b)


def relu(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(x, F.lit(0.0)))


def gcn_stack(edges: DataFrame, features: DataFrame, weights: list[np.ndarray], by: list[str] | None = None) -> DataFrame:
    """Layers of message passing and a linear map, with relu between them."""
    h = features
    for i, w in enumerate(weights):
        h = propagate_vectors(edges, h, by=by, width=len(w)).withColumn("feat", linear(F.col("feat"), w))
        if i < len(weights) - 1:
            h = h.withColumn("feat", relu(F.col("feat")))
    return h


def edge_softmax(edges: DataFrame, score: str, by: str = "dst") -> DataFrame:
    """``attention``: exp(score) over the sum of the target's in-edges. The target's
    maximum and sum are aggregated first, so frequent targets are no hot window."""
    top = edges.groupBy(by).agg(F.max(score).alias("_top"))
    raised = edges.join(top, by).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = raised.groupBy(by).agg(F.sum("_e").alias("_sum"))
    return raised.join(total, by).withColumn("attention", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def mean_pool(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    parts = features.select(*(by or []), F.posexplode("feat").alias("i", "x"))
    return parts.groupBy(*(by or []), "i").agg(F.avg("x").alias("mean"))


def gru_cell(x: np.ndarray, h: np.ndarray, w: dict) -> np.ndarray:
    """Rows of x and h; w: wi (in, 3 d), wh (d, 3 d), bi, bh; gates reset, update, new."""
    return gr.gru(x, h, w)[0]


def lstm_cell(x: np.ndarray, h: np.ndarray, c: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gates input, forget, cell, output."""
    return gr.lstm(x, h, c, w)[0]


def fold(features: DataFrame, step: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, block: int = 64) -> DataFrame:
    """(node, snap, state): ``step`` (inputs, states) -> states over each node's snapshots,
    from zero states. A row holds ``block`` snapshots of a node at most; blocks follow one
    another, and each takes over the last state of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series, before = batch.column("s"), batch.column("state")
            at, rows = np.asarray(series.offsets, dtype=np.int64), series.flatten()
            if not len(rows):
                continue
            count = np.diff(at)
            at = at[:-1] - at[0]
            snap, feat = rows.field("snap"), rows.field("feat")
            x = feat.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            h = np.zeros((len(batch), width))
            known = np.flatnonzero(before.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                h[known] = before.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(known), width)
            out = np.empty((len(rows), width))
            for t in range(int(count.max())):
                live = np.flatnonzero(count > t)
                h[live] = step(x[at[live] + t], h[live])
                out[at[live] + t] = h[live]
            nodes = pa.array(np.repeat(batch.column("node").to_numpy(), count))
            states = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([nodes, snap, states], names=["node", "snap", "state"])

    features = materialise(features)  # read for the bounds, and by every block
    first, last = features.agg(F.min("snap"), F.max("snap")).first()
    out = carried = None
    for low in range(first or 0, (last or 0) + 1, block):
        part = features.where(F.col("snap").between(low, low + block - 1)).groupBy(F.col("node").cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("snap").cast("long").alias("snap"), "feat"))).alias("s"))
        part = part.withColumn("state", F.lit(None).cast("array<double>")) if carried is None else part.join(carried, "node", "left")
        found = part.mapInArrow(run, "node long, snap long, state array<double>")
        if out is None and low + block > (last or 0):
            return found
        found = materialise(found)
        latest = found.groupBy("node").agg(F.max_by("state", "snap").alias("state"))
        carried = materialise(latest if carried is None else carried.withColumnRenamed("state", "_old").join(latest, "node", "full").select("node", F.coalesce("state", "_old").alias("state")))
        out = found if out is None else out.union(found)
    return out


def recurrent(features: DataFrame, weights: dict, cell: str = "gru", block: int = 64) -> DataFrame:
    """(node, snap, state): one recurrent cell over each node's snapshots."""
    d = weights["wh"].shape[0]
    if cell == "gru":
        return fold(features, lambda x, h: gru_cell(x, h, weights), d, block)
    both = fold(features, lambda x, s: np.concatenate(lstm_cell(x, s[:, :d], s[:, d:], weights), axis=1), 2 * d, block)
    return both.withColumn("state", F.slice("state", 1, d))


def on_all_nodes(values: DataFrame, nodes: DataFrame, snaps: int, width: int) -> DataFrame:
    """(node, snap, feat) of every node in every snapshot, zeros where there is no row."""
    spine = nodes.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(snaps - 1).cast("long"))).alias("snap"))
    return spine.join(values.select("node", "snap", "feat"), ["node", "snap"], "left").select("node", "snap", F.coalesce("feat", F.array_repeat(F.lit(0.0), width)).alias("feat"))


def tgcn_cell(x: np.ndarray, h: np.ndarray, w: dict) -> np.ndarray:
    """Gates from thirds of x, each joined to the state: u, r and the candidate c."""
    return gr.tgcn(x, h, w)[0]


def tgcn(edges: DataFrame, features: DataFrame, weights: dict, nodes: DataFrame, snaps: int, block: int = 64) -> DataFrame:
    """(node, snap, state): a graph convolution of each snapshot gives the gates of a
    recurrent unit that runs over the snapshots. weights: gcn (two matrices, the last with
    three times the state's width), u, r, c with biases bu, br, bc."""
    x = gcn_stack(edges, features, weights["gcn"], ["snap"])
    d = weights["u"].shape[1]
    return fold(on_all_nodes(x, nodes, snaps, 3 * d), lambda a, h: tgcn_cell(a, h, weights), d, block)


def mpnn_lstm(edges: DataFrame, features: DataFrame, weights: dict, nodes: DataFrame, snaps: int, block: int = 64) -> DataFrame:
    """(node, snap, state): a graph convolution of each snapshot, then two LSTM cells on
    top of each other; the state is hidden and cell of the first, then of the second.
    weights: gcn, first and second (wi, wh, bi, bh)."""
    x = gcn_stack(edges, features, weights["gcn"], ["snap"])
    d = weights["first"]["wh"].shape[0]

    def step(a: np.ndarray, s: np.ndarray) -> np.ndarray:
        h1, c1 = lstm_cell(a, s[:, :d], s[:, d : 2 * d], weights["first"])
        h2, c2 = lstm_cell(h1, s[:, 2 * d : 3 * d], s[:, 3 * d :], weights["second"])
        return np.concatenate([h1, c1, h2, c2], axis=1)

    return fold(on_all_nodes(x, nodes, snaps, weights["gcn"][-1].shape[1]), step, 4 * d, block)


def mat_gru_cell(context: np.ndarray, weight: np.ndarray, w: dict) -> np.ndarray:
    """A weight matrix evolved by a context vector, the same for each of its rows."""
    x = np.tile(context, (len(weight), 1))
    z = gr.sigmoid(np.concatenate([x, weight], axis=1) @ w["z"] + w["bz"])
    r = gr.sigmoid(np.concatenate([x, weight], axis=1) @ w["r"] + w["br"])
    h = np.tanh(np.concatenate([x, r * weight], axis=1) @ w["h"] + w["bh"])
    return z * weight + (1 - z) * h


def evolved_matrices(features: DataFrame, weights: dict, n_nodes: int) -> list[tuple[int, np.ndarray]]:
    """(snap, matrix), one for each snapshot: a recurrent cell evolves the matrix from the
    mean of the snapshot's features over all nodes."""
    sums = features.select("snap", F.posexplode("feat").alias("i", "x")).groupBy("snap", "i").agg((F.sum("x") / n_nodes).alias("x"))
    rows = sums.groupBy("snap").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x")).orderBy("snap").collect()
    matrix, evolved = weights["start"], []
    for r in rows:
        matrix = mat_gru_cell(np.array(r["x"]) @ weights["pool"] + weights["bpool"], matrix, weights["cell"])
        evolved.append((int(r["snap"]), matrix))
    return evolved


def with_matrices(edges: DataFrame, features: DataFrame, evolved: list[tuple[int, np.ndarray]]) -> DataFrame:
    """(snap, node, feat): each snapshot's messages times its own matrix. The matrices are
    one small row for each snapshot."""
    rows = [(snap, matrix.T.tolist()) for snap, matrix in evolved]
    table = F.broadcast(features.sparkSession.createDataFrame(rows, "snap long, _columns array<array<double>>"))
    passed = propagate_vectors(edges, features, by=["snap"], width=len(evolved[0][1]) if evolved else 0).join(table, "snap")
    dot = lambda c: F.aggregate(F.zip_with("feat", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return passed.select("snap", "node", F.transform("_columns", dot).alias("feat"))


def evolvegcn(edges: DataFrame, features: DataFrame, weights: dict, n_nodes: int) -> DataFrame:
    """(snap, node, feat): each snapshot's messages times a matrix that a recurrent cell
    evolves. weights: start, pool and bpool, cell (z, r, h, bz, br, bh)."""
    return with_matrices(edges, features, evolved_matrices(features, weights, n_nodes))


def memory_update(mail: DataFrame, memory: DataFrame, weights: dict, slots: int) -> DataFrame:
    """(node, memory) of the nodes with mail: a recurrent unit over a node's slots in their
    own order (zeros in empty ones), then a cell of its result and the node's memory.
    mail: (node, slot, mail); weights: mail and cell (wi, wh, bi, bh each)."""
    width, d = weights["mail"]["wi"].shape[0], weights["cell"]["wh"].shape[0]
    held = mail.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "mail"))).alias("m"))  # no more than ``slots``
    one = lambda i: F.coalesce(F.try_element_at("m", i), F.array_repeat(F.lit(0.0), width))
    rows = held.join(memory.select("node", "memory"), "node", "left").select("node", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), one)).alias("x"), F.coalesce("memory", F.array_repeat(F.lit(0.0), d)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), slots, width)
            current = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d)
            h = np.zeros((len(batch), d))
            for k in range(slots):
                h = gru_cell(x[:, k], h, weights["mail"])
            new = gru_cell(h, current, weights["cell"])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * d), pa.array(new.ravel()))], names=["node", "memory"])

    return rows.mapInArrow(run, "node long, memory array<double>")


def temporal_attention(neighbours: DataFrame, nodes: DataFrame, edge_features: DataFrame, weights: dict, heads: int, dim_time: int, roots: DataFrame | None = None) -> DataFrame:
    """(root, root_ts, feat): several attention heads over each root's sampled neighbours.
    Queries are of the root's features and a zero time, keys and values of a neighbour's
    features, the event's and the encoded time gap; scores go through a leaky relu and a
    softmax over the root's neighbours; the result is joined to the root's features, mapped,
    put through a relu and normalised. ``roots`` without neighbours have zeros in its place.
    weights: q, k, v, out with biases bq, bk, bv, bout; nodes: (node, feat); edge_features:
    (eid, feat). A root's few neighbours meet in one row, and a batch of rows is one pass."""
    dim = len(weights["out"]) - weights["v"].shape[1]
    own = nodes.select(F.col("node").alias("root"), F.col("feat").alias("own"))
    near = nodes.select(F.col("node").alias("nbr"), F.col("feat").alias("_n"))
    events = edge_features.select(F.col("eid").alias("nbr_eid"), F.col("feat").alias("_e"))
    joined = neighbours.join(near, "nbr").join(events, "nbr_eid")
    held = joined.groupBy("root", "root_ts").agg(F.array_sort(F.collect_list(F.struct("nbr_eid", F.col("dt").cast("double").alias("dt"), F.concat("_n", "_e").alias("x")))).alias("near"))
    if roots is not None:
        held = roots.select("root", "root_ts").distinct().join(held, ["root", "root_ts"], "left")
    rows = held.join(own, "root").select("root", "root_ts", "own", F.coalesce("near", F.array()).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            count = np.diff(np.asarray(batch.column("near").offsets, dtype=np.int64))
            flat = batch.column("near").flatten()
            x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, len(weights["k"]) - dim_time))
            mine = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
            out, _ = gr.attention(mine, x, flat.field("dt").to_numpy(zero_copy_only=False), count, weights, heads, dim_time)
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("root_ts"), vectors(out)], names=["root", "root_ts", "feat"])

    root_ts = dict(rows.dtypes)["root_ts"]
    return rows.mapInArrow(run, f"root long, root_ts {root_ts}, feat array<double>")


def vectors(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def link_logits(pairs: DataFrame, weights: dict, src: str = "src_feat", dst: str = "dst_feat") -> DataFrame:
    """Pairs with ``logit``: out(relu(src_map(src) + dst_map(dst))). weights: src, dst, out
    with biases bsrc, bdst, bout."""
    both = F.zip_with(linear(F.col(src), weights["src"], weights["bsrc"]), linear(F.col(dst), weights["dst"], weights["bdst"]), lambda a, b: a + b)
    return pairs.withColumn("logit", F.element_at(linear(relu(both), weights["out"], weights["bout"]), 1))


def readout(states: DataFrame, matrix: np.ndarray, bias: np.ndarray, state: str = "state") -> DataFrame:
    """States with ``pred``, a linear map of the last ``len(matrix)`` entries."""
    return states.withColumn("pred", linear(F.slice(state, -len(matrix), len(matrix)), matrix, bias))


def classify(rows: DataFrame, weights: dict, feat: str = "feat") -> DataFrame:
    """Rows with ``logits`` of the classes and ``predicted``, the largest of them (the first
    of equal ones): a linear map, relu and a second linear map. weights: hidden, out with
    biases bhidden, bout."""
    logits = linear(relu(linear(F.col(feat), weights["hidden"], weights["bhidden"])), weights["out"], weights["bout"])
    return rows.withColumn("logits", logits).withColumn("predicted", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))


def normalised_layer(vector: Column) -> Column:
    n = F.size(vector)
    mean = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v) / n
    var = F.aggregate(vector, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n
    return F.transform(vector, lambda x: (x - mean) / F.sqrt(var + 1e-5))


def feature_summary(edges: DataFrame, parts: DataFrame, features: DataFrame) -> DataFrame:
    """(part, first, second, local_share, node_share): means of the first two features of a
    part's nodes, the share of its edges that come from itself, its share of all nodes."""
    one, two = (parts.select(F.col("node").alias(e), F.col("part").alias(f"_{e}")) for e in ("src", "dst"))
    shares = edges.join(one, "src").join(two, "dst").groupBy(F.col("_dst").alias("part")).agg(F.avg((F.col("_src") == F.col("_dst")).cast("double")).alias("local_share"))
    own = parts.join(features, "node", "left").groupBy("part").agg(F.avg(F.col("feat")[0]).alias("first"), F.avg(F.col("feat")[1]).alias("second"), F.count("*").alias("n"))
    # a row for each part
    own = own.withColumn("node_share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return own.join(shares, "part", "left").select("part", "first", "second", "local_share", "node_share")
