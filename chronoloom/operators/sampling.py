"""Negatives and space-time chunks with their dependencies."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.events import running_in, with_row_number


def pool(edges: DataFrame) -> DataFrame:
    """(i, node): the distinct targets of the whole graph, numbered."""
    return with_row_number(edges.select(F.col("dst").alias("node")).distinct(), "node", name="i").select("i", "node")


def negatives(edges: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(eid, src, dst, neg): a target by an arithmetic hash; one that is the event's own
    moves to the next place of the pool once."""
    n = targets.count()
    prime = F.lit(2147483647)
    # the remainder first: large ids do not overflow
    draw = F.pmod(F.pmod("eid", prime) * 48271 + seed, prime)
    if n > 2147483647:  # two residues, so that every target can be drawn
        draw = F.pmod(F.pmod("eid", prime) * 16807 + seed, prime) * prime + draw
    drawn = edges.select("eid", "src", "dst", F.pmod(draw, F.lit(n)).alias("i"))
    first = drawn.join(targets.select("i", F.col("node").alias("neg")), "i")
    moved = first.withColumn("i", F.when(F.col("neg") == F.col("dst"), F.pmod(F.col("i") + 1, F.lit(n))).otherwise(F.col("i")))
    return moved.drop("neg").join(targets.select("i", F.col("node").alias("neg")), "i").select("eid", "src", "dst", "neg")


def without_positives(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that are no edge anywhere and no loop."""
    return pairs.where("src != neg").join(edges.select("src", F.col("dst").alias("neg")).distinct(), ["src", "neg"], "left_anti")


def chunks(edges: DataFrame, slice_: Column, clusters: DataFrame) -> DataFrame:
    """Edges with slice, both clusters, and the chunk's cluster (-1 where they differ)."""
    one, two = (clusters.select(F.col("node").alias(e), F.col("cluster").alias(f"{e}_cluster")) for e in ("src", "dst"))
    return edges.withColumn("slice", slice_).join(one, "src").join(two, "dst").withColumn("cluster", F.when(F.col("src_cluster") == F.col("dst_cluster"), F.col("src_cluster")).otherwise(-1))


def chunk_table(chunked: DataFrame, least: int = 1) -> DataFrame:
    """(chunk_id, slice, cluster, n_edges, t_start, t_end) of chunks with enough edges."""
    each = chunked.groupBy("slice", "cluster").agg(F.count("*").alias("n_edges"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end")).where(F.col("n_edges") >= least)
    return with_row_number(each, "slice", "cluster", name="chunk_id")


def cross_edges(chunked: DataFrame) -> DataFrame:
    """(slice, from_cluster, to_cluster, n): edges between clusters."""
    return chunked.where("src_cluster != dst_cluster").groupBy("slice", F.col("src_cluster").alias("from_cluster"), F.col("dst_cluster").alias("to_cluster")).agg(F.count("*").alias("n"))


def temporal_deps(table: DataFrame, steps: int | None, decay: float = 0.9, same_cluster: bool = True) -> DataFrame:
    """(chunk_id, dep, steps_back, weight): the ``steps`` chunks before each, the latest
    first; all of them where ``steps`` is None, which makes a table of the square of the
    slices. Within a cluster, chunks are numbered by slice; earlier ones are the numbers
    below."""
    group = F.col("cluster") if same_cluster else F.lit(0)
    order = Window.partitionBy("g").orderBy("slice")
    grouped = table.select("chunk_id", "slice", "cluster", group.alias("g"))
    mine = grouped.select("chunk_id", "g", F.row_number().over(order.orderBy("slice", F.desc("cluster"))).alias("n"), F.rank().over(order).alias("r"))
    low = F.lit(1) if steps is None else F.greatest(F.lit(1), F.col("r") - steps)
    wanted = mine.where("r > 1").select("chunk_id", "g", "r", F.explode(F.sequence(low, F.col("r") - 1)).alias("n"))
    found = wanted.join(mine.select("g", "n", F.col("chunk_id").alias("dep")), ["g", "n"])
    back = (F.col("r") - F.col("n")).cast("long")
    return found.select("chunk_id", "dep", back.alias("steps_back"), F.pow(F.lit(decay), back).alias("weight"))


def graph_deps(chunked: DataFrame) -> DataFrame:
    """(slice, cluster, dep_cluster): clusters of a slice that an edge joins."""
    both = chunked.where("src_cluster != dst_cluster").select("slice", F.explode(F.array(F.struct(F.col("src_cluster").alias("a"), F.col("dst_cluster").alias("b")), F.struct(F.col("dst_cluster").alias("a"), F.col("src_cluster").alias("b")))).alias("p"))
    return both.select("slice", F.col("p.a").alias("cluster"), F.col("p.b").alias("dep_cluster")).distinct()


def remote_nodes(chunked: DataFrame) -> DataFrame:
    """(slice, cluster, node, home, n): nodes of other clusters that a chunk's edges need."""
    out = chunked.where("src_cluster != dst_cluster").select("slice", F.explode(F.array(F.struct(F.col("src_cluster").alias("cluster"), F.col("dst").alias("node"), F.col("dst_cluster").alias("home")), F.struct(F.col("dst_cluster").alias("cluster"), F.col("src").alias("node"), F.col("src_cluster").alias("home")))).alias("r"))
    return out.groupBy("slice", "r.cluster", "r.node", "r.home").agg(F.count("*").alias("n"))


def chunk_nodes(chunked: DataFrame) -> DataFrame:
    """(slice, cluster, node, is_remote): the nodes that a chunk's edges need, its own and
    those of other clusters."""
    ends = chunked.select("slice", F.explode(F.array(*[F.struct(F.col(c).alias("cluster"), F.col(n).alias("node"), (F.col(c) != F.col(h)).alias("is_remote")) for c in ("src_cluster", "dst_cluster") for n, h in (("src", "src_cluster"), ("dst", "dst_cluster"))])).alias("e"))
    return ends.select("slice", "e.*").distinct()


def prepared(chunked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(slice, cluster, eid, src_local, dst_local, neg_local): edges inside a chunk with
    node numbers of their own, and the negative where it lies in the chunk too. pairs:
    (eid, neg)."""
    inner = chunked.where("src_cluster = dst_cluster").select("slice", "cluster", "eid", "src", "dst")
    nodes = inner.select("slice", "cluster", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("_key", F.struct("slice", "cluster"))
    local = running_in(nodes, "_key", ["node"], "local").select("slice", "cluster", "node", "local")
    out = inner.join(pairs.select("eid", "neg"), "eid", "left")
    for end, how in (("src", "inner"), ("dst", "inner"), ("neg", "left")):
        out = out.join(local.select("slice", "cluster", F.col("node").alias(end), F.col("local").alias(f"{end}_local")), ["slice", "cluster", end], how)
    return out.select("slice", "cluster", "eid", "src_local", "dst_local", "neg_local")


def completed(needed: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """The needed nodes with their features, zeros where there are none."""
    return needed.join(features, "node", "left").withColumn("feat", F.coalesce("feat", F.array_repeat(F.lit(0.0), width)))


def largest_first(loads: DataFrame, devices: int) -> list[tuple[int, int]]:
    """(chunk, device): chunks by falling load to the device with the least so far. One
    row for each chunk comes to the driver; the rule is sequential by nature."""
    heap = [(0.0, d) for d in range(devices)]
    out = []
    for chunk, load in loads.orderBy(F.desc("load"), "chunk_id").select("chunk_id", "load").toLocalIterator():
        total, device = heapq.heappop(heap)
        out.append((chunk, device))
        heapq.heappush(heap, (total + float(load), device))
    return out


def memory_estimate(nodes: int, edges: int, dim: int, width: int = 4) -> int:
    """Bytes of node features, edge ends and four times the activations."""
    return nodes * dim * width * (1 + 4) + edges * 2 * width
