"""Graph partitions: owners, halo and routes, normalisation, chunk orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.events import running_in, with_row_number
from chronoloom.scratch import materialise


def round_robin(node: Column, parts: int) -> Column:
    return F.pmod(node, F.lit(parts)).cast("int")


def contiguous(node: Column, nodes: int, parts: int) -> Column:
    """floor(node * parts / nodes) of dense ids."""
    return F.floor(node * parts / nodes).cast("int")


def mixed(node: Column, add: int = 11) -> Column:
    """A number below 2 ** 31 - 1 that looks random, by arithmetic that any engine has."""
    prime = F.lit(2147483647)
    return F.pmod(F.pmod(node, prime) * 48271 + add, prime)


def hashed(node: Column, parts: int) -> Column:
    return F.pmod(mixed(node), F.lit(parts)).cast("int")


def label_propagation(edges: DataFrame, parts: int, rounds: int = 3, slack: float = 1.1) -> DataFrame:
    """(node, part): starts from a hash and moves nodes to the part that most of their
    neighbours have, while that part is below ``slack`` times the mean size. A
    deterministic substitute for a multilevel partitioner."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "nbr").where("node != nbr").distinct()
    at = materialise(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("part", hashed(F.col("node"), parts)))
    for r in range(rounds):
        sizes = at.groupBy("part").agg(F.count("*").alias("size"))
        votes = both.join(at.withColumnRenamed("node", "nbr"), "nbr").groupBy("node", "part").agg(F.count("*").alias("votes"))
        # one row for each part
        room = sizes.withColumn("room", F.floor(F.sum("size").over(Window.partitionBy()) / parts * slack) - F.col("size"))
        best = votes.groupBy("node").agg(F.max_by("part", F.struct("votes", (-F.col("part")).alias("p"))).alias("to"))
        moves = at.join(best, "node").where("part != to").withColumn("turn", F.pmod(mixed(F.col("node"), 101 + r), F.lit(1 << 20)))
        wanted = moves.groupBy("to").agg(F.count("*").alias("wanted"))
        share = wanted.join(F.broadcast(room.withColumnRenamed("part", "to")), "to").select("to", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("room") / F.col("wanted"))).alias("share"))
        go = moves.join(F.broadcast(share), "to").where(F.col("turn") < F.col("share") * (1 << 20)).select("node", "to")
        at = materialise(at.join(go, "node", "left").select("node", F.coalesce("to", "part").alias("part")))
    return at


def hot_aware(edges: DataFrame, parts: int, ratio: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(node parts, edge parts) of a vertex cut: edges go with their cold end, and edges
    between two hot nodes are dealt out by both ends."""
    hot = hot_nodes(edges, ratio).select("node", F.lit(1).alias("hot"))
    marked = edges.join(hot.select(F.col("node").alias("src"), F.col("hot").alias("hot_src")), "src", "left").join(hot.select(F.col("node").alias("dst"), F.col("hot").alias("hot_dst")), "dst", "left")
    key = F.when(F.col("hot_src").isNull(), F.col("src")).when(F.col("hot_dst").isNull(), F.col("dst"))
    part = F.coalesce(hashed(key, parts), F.pmod(mixed(F.col("src")) + mixed(F.col("dst")), F.lit(parts)).cast("int"))
    edge_parts = marked.select("eid", part.alias("part"))
    node_parts = marked.select(F.explode(F.array("src", "dst")).alias("node"), part.alias("part")).distinct()
    return node_parts, edge_parts


def repaired(parts: DataFrame) -> DataFrame:
    """Nodes with part -1 are dealt round robin over the parts in use, in node order."""
    top = parts.agg(F.max("part")).first()[0]
    missing = with_row_number(parts.where("part = -1").select("node"), "node", name="_i").select("node", F.pmod("_i", F.lit(int(top) + 1)).cast("int").alias("part"))
    return parts.where("part != -1").select("node", F.col("part").cast("int").alias("part")).unionByName(missing)


def part_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("n_nodes"))


def manifest(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, n_nodes, n_edges, n_halo, n_cross): owned nodes, edges by their target, nodes
    needed from other parts, edges that come from them."""
    placed = _ends(edges, parts)
    counts = placed.groupBy(F.col("dst_part").alias("part")).agg(F.count("*").alias("n_edges"), F.sum((F.col("src_part") != F.col("dst_part")).cast("long")).alias("n_cross"))
    halos = halo(edges, parts).groupBy("part").agg(F.count("*").alias("n_halo"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return part_sizes(parts).join(counts, "part", "left").join(halos, "part", "left").select("part", "n_nodes", zero("n_edges"), zero("n_halo"), zero("n_cross"))


def loss_scales(parts: DataFrame) -> DataFrame:
    """(part, scale): a part's share of all nodes, which its loss counts with."""
    sizes = part_sizes(parts)
    return sizes.select("part", (F.col("n_nodes") / F.sum("n_nodes").over(Window.partitionBy())).alias("scale"))  # a row for each part


def is_local(nodes: DataFrame, parts: DataFrame, rank: int) -> DataFrame:
    """Nodes with whether a part owns them."""
    return nodes.join(parts, "node").select("node", (F.col("part") == rank).alias("is_local"))


def packed_by_owner(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, node, position): what is sent to each owner, in order."""
    return running_in(nodes.select("node").distinct().join(parts, "node").select("part", "node"), "part", ["node"], "position")


def scattered_back(values: DataFrame, halos: DataFrame) -> DataFrame:
    """(part, node, value): what parts hold for nodes of their halo, summed at the owners.
    values: (part, node, value)."""
    return values.join(halos, ["part", "node"]).groupBy(F.col("owner").alias("part"), "node").agg(F.sum("value").alias("value"))


def edge_owner(edges: DataFrame, parts: DataFrame, end: str = "src") -> DataFrame:
    """(eid, part): an edge goes with one of its ends."""
    return edges.join(parts.withColumnRenamed("node", end), end).select("eid", "part")


def _ends(edges: DataFrame, parts: DataFrame) -> DataFrame:
    one, two = (parts.select(F.col("node").alias(e), F.col("part").alias(f"{e}_part")) for e in ("src", "dst"))
    return edges.join(one, "src").join(two, "dst")


def halo(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, node, owner): nodes that a part needs for its edges and does not own."""
    return _ends(edges, parts).where("src_part != dst_part").select(F.col("dst_part").alias("part"), F.col("src").alias("node"), F.col("src_part").alias("owner")).distinct()


def route_sizes(halos: DataFrame) -> DataFrame:
    """(src_part, dst_part, n): nodes sent from owners to needers."""
    return halos.groupBy(F.col("owner").alias("src_part"), F.col("part").alias("dst_part")).agg(F.count("*").alias("n"))


def local_index(parts: DataFrame, halos: DataFrame) -> DataFrame:
    """(part, node, is_halo, local): own nodes first, then the halo by owner."""
    own = parts.select("part", "node", F.lit(0).alias("is_halo"), F.lit(-1).alias("owner"))
    all_ = own.unionByName(halos.select("part", "node", F.lit(1).alias("is_halo"), "owner"))
    placed = running_in(all_, "part", ["is_halo", "owner", "node"], "local")
    return placed.select("part", "node", F.col("is_halo").cast("boolean").alias("is_halo"), "local")


def send_index(halos: DataFrame, index: DataFrame) -> DataFrame:
    """(src_part, dst_part, node, local): what an owner sends, by its own local index."""
    own = index.where("not is_halo").select(F.col("part").alias("owner"), "node", "local")
    return halos.join(own, ["owner", "node"]).select(F.col("owner").alias("src_part"), F.col("part").alias("dst_part"), "node", "local")


def block_edges(edges: DataFrame, parts: DataFrame, index: DataFrame) -> DataFrame:
    """(part, eid, src_local, dst_local, weight): edges of the part that owns their target."""
    placed = _ends(edges, parts).select("eid", "src", "dst", "weight", F.col("dst_part").alias("part"))
    one, two = (index.select("part", F.col("node").alias(e), F.col("local").alias(f"{e}_local")) for e in ("src", "dst"))
    return placed.join(one, ["part", "src"]).join(two, ["part", "dst"]).select("part", "eid", "src_local", "dst_local", "weight")


def gcn_norm(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges with w / (sqrt(in-degree of target) sqrt(out-degree of source))."""
    by = by or []
    ins = edges.groupBy(*by, "dst").agg(F.sum("weight").alias("_in"))
    outs = edges.groupBy(*by, "src").agg(F.sum("weight").alias("_out"))
    root = lambda c: F.sqrt(F.greatest(F.col(c), F.lit(1e-12)))
    return edges.join(ins, [*by, "dst"]).join(outs, [*by, "src"]).withColumn("norm", F.nanvl(F.col("weight") / (root("_in") * root("_out")), F.lit(0.0))).drop("_in", "_out")


def mean_norm(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges with w / max(in-weight of target, 1)."""
    by = by or []
    ins = edges.groupBy(*by, "dst").agg(F.sum("weight").alias("_in"))
    return edges.join(ins, [*by, "dst"]).withColumn("norm", F.col("weight") / F.greatest("_in", F.lit(1.0))).drop("_in")


def cross_ratio(edges: DataFrame, parts: DataFrame) -> DataFrame:
    return _ends(edges, parts).agg(F.avg((F.col("src_part") != F.col("dst_part")).cast("double")).alias("ratio"), F.count("*").alias("n_edges"))


def adapted_count(ratio: float, count: int, limit: float = 0.2) -> int:
    """More clusters when the share of crossing edges is above a limit."""
    return int(count * ratio / limit) if ratio > limit else count


#: Rank of a chunk among n by mode; "none" has no order, any other name keeps the chunk's own.
ORDERS = {"reverse": lambda chunk, n: F.lit(n - 1) - chunk, "rand": lambda chunk, n: mixed(chunk), "random": lambda chunk, n: mixed(chunk)}
#: Decay steps by name; no other names have any.
DECAYS = {"half": lambda n: [max(1, n // 2)], "all": lambda n: range(1, n + 1)}


def chunk_order(mode: str | None, chunks: int) -> Column | None:
    """Rank of a chunk: identity, reverse, a fixed shuffle (rand, random) or none."""
    rank = ORDERS.get(mode, lambda chunk, n: chunk)
    return None if mode in (None, "none") else rank(F.col("chunk"), chunks)


def chunk_decay(value, chunks: int) -> list[int]:
    """Steps of a decay, each from 1 to the number of chunks: a number stands for all steps
    up to it, a list for itself; half, all or none."""
    wanted = DECAYS.get(value, lambda n: [])(chunks) if value is None or isinstance(value, str) else range(1, max(1, value) + 1) if isinstance(value, int) else value
    return sorted({min(chunks, max(1, int(step))) for step in wanted if chunks > 0})


def chunk_ends(nodes: DataFrame, rank: Column) -> DataFrame:
    """(rank, end): nodes in chunks up to each rank. A row for each chunk."""
    each = nodes.withColumn("rank", rank).groupBy("rank").agg(F.count("*").alias("n"))
    return each.select(F.col("rank").cast("long").alias("rank"), F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))


def reordered(order: DataFrame, score: str = "score") -> DataFrame:
    """Chunks renumbered by falling score; a row for each chunk."""
    return order.select("chunk", (F.row_number().over(Window.orderBy(F.desc(score), "chunk")) - 1).cast("long").alias("rank"))


def permuted(nodes: DataFrame, rank: Column, parts: str = "part") -> DataFrame:
    """Nodes with their place by chunk rank inside each part."""
    return running_in(nodes.withColumn("_rank", rank), parts, ["_rank", "node"], "place").drop("_rank")


def permuted_edges(block: DataFrame, places: DataFrame) -> DataFrame:
    """Edges of a block with both ends moved to their places; places: (part, local, place),
    halo nodes keep theirs where it has no row for them."""
    for end in ("src_local", "dst_local"):
        moved = places.select("part", F.col("local").alias(end), F.col("place").alias("_place"))
        block = block.join(moved, ["part", end], "left").withColumn(end, F.coalesce("_place", end)).drop("_place")
    return block


def permuted_send(send: DataFrame, places: DataFrame) -> DataFrame:
    """A send list with its local indexes moved to their places."""
    moved = places.select(F.col("part").alias("src_part"), "local", "place")
    return send.join(moved, ["src_part", "local"], "left").select("src_part", "dst_part", "node", F.coalesce("place", "local").alias("local"))


def snapshot_blocks(snap_edges: DataFrame, parts: DataFrame, index: DataFrame) -> DataFrame:
    """(part, snap, eid, src_local, dst_local, norm): a block for each part and snapshot,
    edges with the normalisation of their snapshot, local to the part of their target."""
    normed = gcn_norm(snap_edges, ["snap"])
    placed = _ends(normed, parts).select("eid", "snap", "src", "dst", "norm", F.col("dst_part").alias("part"))
    one, two = (index.select("part", F.col("node").alias(e), F.col("local").alias(f"{e}_local")) for e in ("src", "dst"))
    return placed.join(one, ["part", "src"]).join(two, ["part", "dst"]).select("part", "snap", "eid", "src_local", "dst_local", "norm")


def second_level(edges: DataFrame, parts: DataFrame, chunks: int) -> DataFrame:
    """(node, part, chunk): each part's nodes in ``chunks`` chunks (in one each, if there are
    fewer nodes), moved towards their neighbours over the edges inside the part."""
    inner = _ends(edges, parts).where("src_part = dst_part").select(F.col("src_part").alias("slice"), "src", "dst")
    sizes = F.broadcast(part_sizes(parts))  # a row for each part
    count = F.least(F.lit(chunks), F.col("n_nodes")).cast("int")
    ranked = running_in(parts.select("node", "part"), "part", ["node"], "_i").join(sizes, "part")
    at = ranked.select(F.col("part").alias("slice"), "node", F.pmod("_i", count).cast("int").alias("cluster"), count.alias("count"))
    return _towards_neighbours(inner, materialise(at)).select("node", F.col("slice").alias("part"), F.col("cluster").alias("chunk"))


def slice_clusters(slice_edges: DataFrame, clusters: int, limit: float = 0.2, tries: int = 3) -> DataFrame:
    """(slice, node, cluster): nodes of each slice clustered on their own. Where more than
    ``limit`` of a slice's edges cross, the number of clusters grows as ``adapted_count``
    says and the slice is clustered again, ``tries`` times at most."""
    counts = None
    for _ in range(tries):
        ends = slice_edges.select("slice", F.explode(F.array("src", "dst")).alias("node")).distinct()
        sized = ends if counts is None else ends.join(F.broadcast(counts), "slice")
        number = F.lit(clusters) if counts is None else F.col("count")
        at = materialise(sized.select("slice", "node", F.pmod(mixed(F.col("node")), number).cast("int").alias("cluster"), number.cast("int").alias("count")))
        at = _towards_neighbours(slice_edges, at)
        one, two = (at.select("slice", F.col("node").alias(e), F.col("cluster").alias(f"_{e}")) for e in ("src", "dst"))
        crossing = slice_edges.join(one, ["slice", "src"]).join(two, ["slice", "dst"]).groupBy("slice").agg(F.avg((F.col("_src") != F.col("_dst")).cast("double")).alias("ratio"))
        # a row for each slice
        seen = crossing.join(at.groupBy("slice").agg(F.first("count").alias("count")), "slice").withColumn("next", F.when(F.col("ratio") > limit, F.floor(F.col("count") * F.col("ratio") / limit)).otherwise(F.col("count")))
        grown = materialise(seen.select("slice", F.col("next").cast("int").alias("count"), (F.col("next") != F.col("count")).alias("more")))
        if grown.where("more").isEmpty():
            break
        counts = grown.select("slice", "count")
    return at.select("slice", "node", "cluster")


def _towards_neighbours(slice_edges: DataFrame, at: DataFrame, rounds: int = 2, slack: float = 1.2) -> DataFrame:
    """Nodes move to the cluster of most of their neighbours in the slice, while there is
    room in it."""
    both = slice_edges.select("slice", "src", "dst").union(slice_edges.select("slice", "dst", "src")).toDF("slice", "node", "nbr").where("node != nbr").distinct()
    for r in range(rounds):
        sizes = at.groupBy("slice", "cluster").agg(F.count("*").alias("size"))
        total = at.groupBy("slice").agg((F.count("*") / F.first("count") * slack).alias("room"))
        votes = both.join(at.select("slice", F.col("node").alias("nbr"), "cluster"), ["slice", "nbr"]).groupBy("slice", "node", "cluster").agg(F.count("*").alias("votes"))
        best = votes.groupBy("slice", "node").agg(F.max_by("cluster", F.struct("votes", (-F.col("cluster")).alias("c"))).alias("to"))
        moves = at.join(best, ["slice", "node"]).where("cluster != to").withColumn("turn", F.pmod(mixed(F.col("node"), 301 + r), F.lit(1 << 20)))
        wanted = moves.groupBy("slice", "to").agg(F.count("*").alias("wanted"))
        share = wanted.join(sizes.withColumnRenamed("cluster", "to"), ["slice", "to"], "left").join(total, "slice").select("slice", "to", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.floor("room") - F.coalesce("size", F.lit(0))) / F.col("wanted"))).alias("share"))
        go = moves.join(share, ["slice", "to"]).where(F.col("turn") < F.col("share") * (1 << 20)).select("slice", "node", "to")
        at = materialise(at.join(go, ["slice", "node"], "left").select("slice", "node", F.coalesce("to", "cluster").alias("cluster"), "count"))
    return at


def truncated(block: DataFrame, end: int) -> DataFrame:
    """Edges among the first ``end`` local nodes."""
    return block.where((F.col("src_local") < end) & (F.col("dst_local") < end))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, i, nbr, eid): each node's out-edges, numbered by target and event."""
    return running_in(edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "eid"), "node", ["nbr", "eid"], "i")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def hot_nodes(edges: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(node, degree) of the top share of nodes by total degree, ties by the smaller node:
    a histogram of degrees gives the least degree that is in, and only its nodes are
    ranked."""
    each = materialise(edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")))
    wanted = int(ratio * each.count())
    # different degrees: no more than the root of four times the edges
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = each.groupBy("degree").agg(F.count("*").alias("n")).withColumn("above", above).where(F.col("above") < wanted).orderBy("degree").first()
    if last is None:
        return each.limit(0)
    ties = with_row_number(each.where(F.col("degree") == last["degree"]), "node", name="_i").where(F.col("_i") < wanted - last["above"])
    return each.where(F.col("degree") > last["degree"]).union(ties.drop("_i"))
