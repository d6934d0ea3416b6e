"""An epoch over batches of events with memory and mailbox carried from batch to batch.

Each batch is a few Spark jobs over its own nodes: mail and memory of both ends are read,
memory is updated from the mail of earlier batches, the batch's messages (of the memory
before) go into the ring of slots, and roots attend to their neighbours' memory for the
scores. State is a base table with the changes of recent batches beside it; a batch reads
the rows of its own nodes, the changes are merged into a new base every few batches. The
size of a batch is the user's choice: the number of jobs grows with the number of batches,
not with that of events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import gradients as gr
from chronoloom.functions.gradients import Weights
from chronoloom.operators import learning as ln
from chronoloom.operators import temporal as tp
from chronoloom.operators.messages import SMALL_ENTRIES, vectors
from chronoloom.scratch import discard, materialise, shared_folder

#: Nodes whose rows are broadcast to a join at most; beyond that they are shuffled.
SMALL_NODES = 100_000
_NEAR = ("src_near", "dst_near", "neg_near")
_STATE = "node long, memory array<double>, memory_ts double, mail array<double>, pos int"


@dataclass(frozen=True)
class Shape:
    """Sizes of a memory model: memory, event features, time codes, heads and slots.
    ``memory``: false leaves every node's memory as it starts, at zero."""

    dim: int = 8
    width: int = 1
    dim_time: int = 4
    heads: int = 2
    slots: int = 3
    k: int = 5
    time_unit: float = 1e9
    memory: bool = True

    @property
    def message(self) -> int:
        return 2 * self.dim + self.width


def initial_weights(s: Shape, seed: int) -> Weights:
    """Uniform within one over the root of the number of inputs."""
    rng = np.random.default_rng(seed)
    one = lambda a, b: rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
    cell = lambda a, d: {"wi": one(a, 3 * d), "wh": one(d, 3 * d), "bi": np.zeros(3 * d), "bh": np.zeros(3 * d)}
    d, key = s.dim, s.dim + s.width + s.dim_time
    attend = {"q": one(d + s.dim_time, d), "k": one(key, d), "v": one(key, d), "out": one(2 * d, d), **{f"b{n}": np.zeros(d) for n in ("q", "k", "v", "out")}}
    predict = {"src": one(d, d), "dst": one(d, d), "out": one(d, 1), "bsrc": np.zeros(d), "bdst": np.zeros(d), "bout": np.zeros(1)}
    return gr.flattened({"mail": cell(s.message, d), "cell": cell(d, d), "attend": attend, "predict": predict})


@dataclass
class NodeState:
    """Memory and mailbox of nodes: a base table and the changes since."""

    spark: SparkSession
    base: DataFrame | None = None
    changes: list[DataFrame] = field(default_factory=list)
    merge_after: int = 8

    def table(self) -> DataFrame:
        """(node, memory, memory_ts, mail, pos), the latest row of each node."""
        tables = [*([self.base] if self.base is not None else []), *self.changes]
        if not tables:
            return self.spark.createDataFrame([], _STATE)
        if len(tables) == 1:
            return tables[0]
        return self._latest(tables)

    def of(self, nodes: DataFrame, few: bool) -> DataFrame:
        """The rows of the given distinct nodes that have any: filtered before they are
        shuffled or merged. ``few``: the nodes are counted, and can be broadcast."""
        tables = [*([self.base] if self.base is not None else []), *self.changes]
        if not tables:
            return self.table()
        wanted = F.broadcast(nodes) if few else nodes
        return self._latest([t.join(wanted, "node", "left_semi") for t in tables])

    @staticmethod
    def _latest(tables: list[DataFrame]) -> DataFrame:
        every = None
        for version, t in enumerate(tables):
            row = t.select("node", F.struct("memory", "memory_ts", "mail", "pos").alias("s"), F.lit(version).alias("version"))
            every = row if every is None else every.unionByName(row)
        return every.groupBy("node").agg(F.max_by("s", "version").alias("s")).select("node", "s.*")

    def add(self, change: DataFrame) -> None:
        """A written table of changed rows; merged into a new base after a few."""
        self.changes.append(change)
        if len(self.changes) >= self.merge_after:
            old = [*([self.base] if self.base is not None else []), *self.changes]
            self.base, self.changes = materialise(self.table()), []
            discard(*old)

    def copy(self) -> NodeState:
        """The same state, to go on from without a change of this one."""
        if self.changes:
            return NodeState(self.spark, materialise(self.table()), [], self.merge_after)
        return NodeState(self.spark, materialise(self.base) if self.base is not None else None, [], self.merge_after)


def prepared_links(events: DataFrame, visible: DataFrame, negatives: DataFrame, s: Shape) -> DataFrame:
    """Written by batch: (eid, ts, feat, src, dst, neg, src_near, dst_near, neg_near), each
    event with a negative and the latest ``k`` neighbours of all three, among visible events
    in either direction strictly before. events: (eid, src, dst, ts, feat, batch)."""
    spark = events.sparkSession
    rows = materialise(events.join(negatives.select("eid", "neg"), "eid"))
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(end).alias("root")) for i, end in enumerate(("src", "dst", "neg"))]))
    asked = rows.select("eid", F.col("ts").alias("root_ts"), ends.alias("x")).select("eid", "root_ts", "x.side", "x.root")
    turns = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = visible.select("eid", "ts", "feat", turns.alias("x")).select("eid", "x.src", "x.dst", "ts", "feat")
    near = tp.recent_lists(asked, both, s.k)
    scaled = F.transform("near", lambda x: F.struct(x["nbr"].alias("nbr"), (x["dt"].cast("double") / s.time_unit).alias("dt"), x["feat"].alias("feat")))
    # an event's three lists are brought together before they are grouped: vectors are sorted once
    each = near.repartition("eid").groupBy("eid").agg(*[F.max_by(scaled, F.when(F.col("side") == i, F.lit(1))).alias(n) for i, n in enumerate(_NEAR)])
    path = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    out = rows.select("eid", F.col("ts").cast("double").alias("ts"), "feat", "src", "dst", "neg", "batch").join(each, "eid")
    out.write.partitionBy("batch").parquet(path)
    discard(rows)
    return spark.read.parquet(path)


def _matrix(column: pa.Array, rows: int, width: int) -> np.ndarray:
    """A list column as a matrix, zeros for nulls."""
    out = np.zeros((rows, width))
    known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(known):
        out[known] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(known), width)
    return out


def updated_memory(held: DataFrame, incoming: DataFrame, at: float, weights: Weights, s: Shape) -> DataFrame:
    """State rows of a batch's nodes: memory by the mail there was, then the batch's mail.
    A call's messages to a node share a slot, the latest stays, and the ring moves on by
    their number; messages to sources are one call, those to targets the next.
    incoming: (node, n0, mail0, n1, mail1)."""
    rows = incoming.join(held, "node", "left")
    mail_w, cell_w = gr.part(weights, "mail"), gr.part(weights, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            if not n:
                continue
            memory = _matrix(b.column("memory"), n, s.dim)
            mail = _matrix(b.column("mail"), n, s.slots * s.message).reshape(n, s.slots, s.message)
            pos = b.column("pos").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if s.memory:
                h = np.zeros((n, s.dim))
                for k in range(s.slots):
                    h, _ = gr.gru(mail[:, k], h, mail_w)
                memory, _ = gr.gru(h, memory, cell_w)
            for side in ("0", "1"):
                count = b.column(f"n{side}").to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.flatnonzero(count)
                mail[own, pos[own]] = _matrix(b.column(f"mail{side}"), n, s.message)[own]
                pos = (pos + count) % s.slots
            yield pa.RecordBatch.from_arrays([b.column("node"), vectors(memory), pa.array(np.full(n, at)), vectors(mail.reshape(n, -1)), pa.array(pos.astype(np.int32))], names=["node", "memory", "memory_ts", "mail", "pos"])

    return rows.mapInArrow(run, _STATE)


def incoming_mail(events: DataFrame, held: DataFrame, s: Shape, few: bool) -> DataFrame:
    """(node, n0, mail0, n1, mail1): number and last message of a batch for each node, as
    source and as target; a message is own memory, the peer's and the event's feature."""
    zero = F.array_repeat(F.lit(0.0), s.dim)
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("peer"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("node"), F.col("src").alias("peer"), F.lit(1).alias("side"))))
    rows = events.select("eid", "ts", "feat", sides.alias("x")).select("eid", "ts", "feat", "x.*")
    # of a call the last message counts: it is chosen before any vector moves
    last = rows.groupBy("node", "side").agg(F.count("*").alias("n"), F.max(F.struct("ts", "eid", "peer", "feat")).alias("m")).select("node", "side", "n", "m.peer", "m.feat")
    own, peer = (held.select(F.col("node").alias(k), F.col("memory").alias(f"{k}_memory")) for k in ("node", "peer"))
    joined = last.join(F.broadcast(own) if few else own, "node", "left").join(F.broadcast(peer) if few else peer, "peer", "left")
    message = F.concat(F.coalesce("node_memory", zero), F.coalesce("peer_memory", zero), F.slice(F.concat("feat", F.array_repeat(F.lit(0.0), s.width)), 1, s.width))
    each = joined.select("node", "side", "n", message.alias("mail"))
    return each.groupBy("node").agg(*[x for i in (0, 1) for x in (F.coalesce(F.max(F.when(F.col("side") == i, F.col("n"))), F.lit(0)).alias(f"n{i}"), F.max(F.when(F.col("side") == i, F.col("mail"))).alias(f"mail{i}"))])


def _asked(rows: DataFrame) -> DataFrame:
    """(eid, side, place, node): source, target and negative, each followed by its
    neighbours in their order."""
    ends = F.array(*[F.concat(F.array(F.col(end)), F.transform(near, lambda x: x["nbr"])) for end, near in zip(("src", "dst", "neg"), _NEAR, strict=True)])
    return rows.select("eid", F.posexplode(ends).alias("side", "nodes")).select("eid", "side", F.posexplode("nodes").alias("place", "node"))


def _memories(rows: DataFrame, memory: DataFrame, s: Shape, few: bool) -> DataFrame:
    """Events with ``held``: the memory of all that they ask for, in that order."""
    zero = F.array_repeat(F.lit(0.0), s.dim)
    found = _asked(rows).join(F.broadcast(memory) if few else memory, "node", "left").select("eid", F.struct("side", "place", F.coalesce("memory", zero).alias("memory")).alias("x"))
    held = found.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["memory"]).alias("held"))
    return rows.join(held, "eid")


def _places(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Where an event's nodes stand, in the order of ``_asked``: for each side the numbers
    of neighbours, the places of the ends (rows, 3) and those of the neighbours."""
    counts = [np.diff(np.asarray(batch.column(c).offsets, dtype=np.int64)) for c in _NEAR]
    size = np.stack([1 + c for c in counts], axis=1)
    begin = (np.cumsum(size.ravel()) - size.ravel()).reshape(len(batch), 3)
    return counts, begin, [np.repeat(begin[:, i] + 1 - (np.cumsum(c) - c), c) + np.arange(c.sum()) for i, c in enumerate(counts)]


def _looked_up(batch: pa.RecordBatch, known: np.ndarray, memory: np.ndarray) -> np.ndarray:
    """The memory of all that a batch asks for, zeros where there is none. known: sorted."""
    _, begin, at = _places(batch)
    ids = np.empty(begin.size + sum(map(len, at)), dtype=np.int64)
    for side, (end, near) in enumerate(zip(("src", "dst", "neg"), _NEAR, strict=True)):
        ids[begin[:, side]] = batch.column(end).to_numpy(zero_copy_only=False)
        ids[at[side]] = batch.column(near).flatten().field("nbr").to_numpy(zero_copy_only=False)
    if not len(known):
        return np.zeros((len(ids), memory.shape[1]))
    place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where((known[place] == ids)[:, None], memory[place], 0.0)


def link_pass(batch: pa.RecordBatch, weights: Weights, s: Shape, train: bool, held: np.ndarray | None = None):
    """(positive logits, negative logits, loss, gradient) of a batch of rows. held: what
    the nodes have in memory, where it is no column of the batch."""
    counts, begin, places = _places(batch)
    if held is None:
        held = batch.column("held").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, s.dim)
    attend, predict = gr.part(weights, "attend"), gr.part(weights, "predict")
    out, kept = [], []
    for side, name in enumerate(_NEAR):
        flat, count = batch.column(name).flatten(), counts[side]
        at = places[side]
        feat = flat.field("feat")
        x = np.concatenate([held[at], feat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, s.width))], axis=1)
        y, k = gr.attention(held[begin[:, side]], x, flat.field("dt").to_numpy(zero_copy_only=False), count, attend, s.heads, s.dim_time)
        out.append(y)
        kept.append(k)
    pos, pos_kept = gr.link(out[0], out[1], predict)
    neg, neg_kept = gr.link(out[0], out[2], predict)
    (pos_loss, pos_d), (neg_loss, neg_d) = gr.cross_entropy(pos, 1.0), gr.cross_entropy(neg, 0.0)
    loss = float(pos_loss.sum() + neg_loss.sum())
    if not train:
        return pos, neg, loss, None
    ga, gp = gr.zeros(attend), gr.zeros(predict)
    d_src, d_dst = gr.link_back(pos_d, pos_kept, predict, gp)
    more, d_neg = gr.link_back(neg_d, neg_kept, predict, gp)
    for d, k in zip((d_src + more, d_dst, d_neg), kept, strict=True):
        gr.attention_back(d, k, attend, ga)
    return pos, neg, loss, gr.within(ga, "attend") | gr.within(gp, "predict")


def scored_links(rows: DataFrame, weights: Weights, s: Shape, train: bool, memory: Broadcast | None = None) -> DataFrame:
    """(eid, pos, neg, i, g): both logits of each event; where told to, each task's part of
    the gradient as rows of its own. memory: sorted nodes and the matrix of what they have,
    if it is sent to the tasks; if not, rows have it in ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, terms, g = 0.0, 0, None
        names = ["eid", "pos", "neg", "i", "g"]
        for b in batches:
            if not len(b):
                continue
            pos, neg, loss, own = link_pass(b, weights, s, train, None if memory is None else _looked_up(b, *memory.value))
            yield pa.RecordBatch.from_arrays([b.column("eid"), pa.array(pos), pa.array(neg), *ln.no_part(len(b))], names=names)
            total, terms = total + loss, terms + len(b)
            if own is not None:
                g = own if g is None else {k: v + own[k] for k, v in g.items()}
        if g is not None:
            i, values = ln.part_of(total, terms, g)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.float64()), pa.nulls(len(i), pa.float64()), pa.array(i), pa.array(values)], names=names)

    return rows.select("eid", *_NEAR, *(("held",) if memory is None else ("src", "dst", "neg"))).mapInArrow(run, "eid long, pos double, neg double, i int, g double")


def _sent(memory: DataFrame, s: Shape) -> Broadcast:
    """Sorted nodes and the matrix of their memory for the tasks, as a broadcast join would
    send them."""
    t = memory.select("node", "memory").toArrow().combine_chunks()
    nodes = t.column("node").to_numpy()
    order = np.argsort(nodes)
    rows = _matrix(t.column("memory").combine_chunks(), len(t), s.dim) if len(t) else np.zeros((0, s.dim))
    return memory.sparkSession.sparkContext.broadcast((nodes[order], rows[order]))


def memory_epoch(links: DataFrame, state: NodeState, weights: Weights, s: Shape, batches: int, optimiser: ln.Adam | None = None) -> tuple[DataFrame, Weights, list[float]]:
    """Scores (eid, batch, score, label), weights and, with an optimiser, each batch's loss.
    ``state`` goes on over the batches 0 .. batches - 1 of the prepared links."""
    spark = links.sparkSession
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    losses = []
    trained = {k: v for k, v in weights.items() if k.startswith(("attend.", "predict."))}
    for b in range(batches):
        rows = links.where(F.col("batch") == b)
        near = F.concat(F.array("src", "dst", "neg"), *[F.col(c)["nbr"] for c in _NEAR])
        nodes = materialise(rows.select(F.explode(near).alias("node")).distinct())
        n = nodes.count()
        few = n <= SMALL_NODES
        last = rows.agg(F.max("ts")).first()[0]
        if last is None:
            continue
        held = materialise(state.of(nodes, few))
        change = materialise(updated_memory(held, incoming_mail(rows, held, s, few), last, weights, s))
        now = held.join(change.select("node"), "node", "left_anti").select("node", "memory").union(change.select("node", "memory"))
        sent = _sent(now, s) if n * s.dim <= SMALL_ENTRIES else None
        known = _memories(rows, now, s, few) if sent is None else rows
        scored_links(known, weights, s, optimiser is not None, sent).write.parquet(f"{folder}/batch={b}")
        if sent is not None:
            sent.destroy()
        state.add(change)
        discard(nodes, held)
        if optimiser is not None:
            loss, g = ln.summed(spark.read.parquet(f"{folder}/batch={b}"), trained)
            weights = optimiser.step(weights, g)
            losses.append(loss)
    spark.createDataFrame([], "eid long, pos double, neg double, i int, g double").write.parquet(f"{folder}/batch=-1")
    found = spark.read.parquet(folder).where("eid is not null")
    scores = found.select("eid", F.col("batch").cast("long").alias("batch"), F.explode(F.array(F.struct(F.col("pos").alias("score"), F.lit(1).alias("label")), F.struct(F.col("neg").alias("score"), F.lit(0).alias("label")))).alias("x")).select("eid", "batch", "x.score", "x.label")
    return scores, weights, losses
