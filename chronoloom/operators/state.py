"""Mailbox and memory state of nodes, folded from batches of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.events import running_in


def _mail(batches: DataFrame) -> DataFrame:
    """Both ends of each event; side 0 (source) is written before side 1 (target)."""
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("peer"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("node"), F.col("src").alias("peer"), F.lit(1).alias("side"))))
    return batches.select("batch", "eid", "ts", sides.alias("m")).select("batch", "eid", "ts", "m.*")


def mail_writes(batches: DataFrame, slots: int) -> DataFrame:
    """(node, batch, side, slot, eid, ts, n): a call's messages to a node share one slot,
    the latest stays, and the ring moves on by their number."""
    calls = _mail(batches).groupBy("node", "batch", "side").agg(F.count("*").alias("n"), F.max(F.struct("ts", "eid", "peer")).alias("last"))
    placed = running_in(calls, "node", ["batch", "side"], "before", value=F.col("n"))
    return placed.select("node", "batch", "side", F.pmod("before", F.lit(slots)).cast("long").alias("slot"), F.col("last.eid").alias("eid"), F.col("last.ts").alias("ts"), F.col("last.peer").alias("peer"), "n")


def mailbox(batches: DataFrame, slots: int) -> DataFrame:
    """(node, slot, eid, ts, peer): the last message in each slot."""
    writes = mail_writes(batches, slots)
    return writes.groupBy("node", "slot").agg(F.max_by(F.struct("eid", "ts", "peer"), F.struct("batch", "side")).alias("m")).select("node", "slot", "m.*")


def ring_position(batches: DataFrame, slots: int) -> DataFrame:
    """(node, pos): the slot that is written next."""
    return _mail(batches).groupBy("node").agg(F.pmod(F.count("*"), F.lit(slots)).cast("long").alias("pos"))


def messages(mail: DataFrame, memory: DataFrame, features: DataFrame | None = None, width: int = 0) -> DataFrame:
    """Mail with its vector: own memory, the peer's, and the event's feature."""
    own = memory.select("node", F.col("memory").alias("_own"))
    peer = memory.select(F.col("node").alias("peer"), F.col("memory").alias("_peer"))
    joined = mail.join(own, "node", "left").join(peer, "peer", "left")
    feature = F.array().cast("array<double>")
    if features is not None:
        joined = joined.join(features.select("eid", F.col("feat").alias("_feat")), "eid", "left")
        feature = F.slice(F.concat(F.coalesce("_feat", feature), F.array_repeat(F.lit(0.0), width)), 1, width)
    return joined.withColumn("mail", F.concat("_own", "_peer", feature)).drop("_own", "_peer", "_feat")


def memory_last(updates: DataFrame) -> DataFrame:
    """(node, value, ts): the update of the latest time stays."""
    return updates.groupBy("node").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "eid")).alias("m")).select("node", "m.*")


def touched(batches: DataFrame) -> DataFrame:
    """(node, memory_ts): nodes of a batch get the batch's last time; the last batch wins."""
    last = batches.groupBy("batch").agg(F.max("ts").alias("t"))
    return _mail(batches).select("node", "batch").distinct().join(last, "batch").groupBy("node").agg(F.max_by("t", "batch").alias("memory_ts"))


def newer(current: DataFrame, incoming: DataFrame, key: str = "node", ts: str = "ts") -> DataFrame:
    """Rows of both sides; of a key in both, the incoming one only if it is newer."""
    columns = [c for c in current.columns if c != key]
    a = current.select(key, F.struct(*columns).alias("a"))
    b = incoming.select(key, F.struct(*columns).alias("b"))
    take = F.col("a").isNull() | (F.col(f"b.{ts}") > F.col(f"a.{ts}"))
    merged = a.join(b, key, "full").withColumn("m", F.when(F.col("b").isNotNull() & take, F.col("b")).otherwise(F.col("a")))
    return merged.select(key, "m.*")


def gathered(nodes: DataFrame, memory: DataFrame, width: int) -> DataFrame:
    """Memory of the nodes, zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0), width)
    return nodes.join(memory, "node", "left").withColumn("memory", F.coalesce("memory", zero))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-8))
    return dot(a, b) / (norm(a) * norm(b))


def changed(current: DataFrame, cached: DataFrame, alpha: float, key: str = "node", vector: str = "memory") -> DataFrame:
    """``changed``: cosine distance from the cached vector above 1 - alpha, or none cached."""
    old = cached.select(key, F.col(vector).alias("_old"))
    far = 1.0 - cosine(F.col(vector), F.col("_old")) > 1.0 - alpha
    return current.join(old, key, "left").withColumn("changed", F.when(F.col("_old").isNull(), True).otherwise(far)).drop("_old")


def adapted_alpha(alpha: float, sync_ms: float, compute_ms: float) -> float:
    return min(0.95, max(0.1, alpha + 0.01 * (sync_ms / compute_ms - 1.0)))


def padded(nodes: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """State of a larger node set: zeros for nodes that had none."""
    return gathered(nodes, state.select("node", F.col("state").alias("memory")), width).withColumnRenamed("memory", "state")


def mixed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The current state of each node, or the previous one where there is none."""
    return current.withColumnRenamed("state", "_c").join(previous.withColumnRenamed("state", "_p"), "node", "full").select("node", F.coalesce("_c", "_p").alias("state"))


def reuse(accesses: DataFrame) -> DataFrame:
    """(node, slice, next_slice, gap): when a node is needed again; the order in which a
    decaying cache gives nodes up."""
    following = F.lead("slice").over(Window.partitionBy("node").orderBy("slice"))
    return accesses.select("node", "slice").distinct().withColumn("next_slice", following).withColumn("gap", F.col("next_slice") - F.col("slice"))


def most_used(accesses: DataFrame, capacity: int) -> DataFrame:
    """(node, uses): what a least-frequently-used cache of a capacity keeps."""
    return accesses.groupBy("node").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "node").limit(capacity)


def window_states(states: DataFrame, at: int, size: int) -> DataFrame:
    """(age, node, state): states of the last ``size`` snapshots up to one; what a model
    window starts from."""
    return states.where(F.col("snap").between(at - size + 1, at)).select((F.lit(at) - F.col("snap")).alias("age"), "node", "state")
