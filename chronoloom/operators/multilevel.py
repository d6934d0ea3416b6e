"""Multilevel k-way partitioning: matching, contraction, and refinement back through the levels.

A level matches nodes along heavy edges (both ends have to choose each other; nodes left
over by a hub pair up among themselves), and contracts pairs to one node with the sum of
their weights, edges to one with theirs. The coarsest graph starts from a hash, and every
level moves nodes to the part that they hold most edge weight with. Moves go up in the
numbers of parts in one round and down in the next, so that neighbours do not swap, and
into the room that a part has left. In the end, parts above their share give up exactly
what they have too much, cheapest nodes first. All of it is joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.events import running_in
from chronoloom.operators.partitioning import hashed, mixed
from chronoloom.scratch import discard, materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "w").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def graph_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, weight), edges (u, v, w) with u < v): parallel edges are one of their
    number, loops only keep their node."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("weight", F.lit(1).cast("long"))
    pairs = edges.where("src != dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return materialise(nodes), materialise(pairs.groupBy("u", "v").agg(F.count("*").alias("w")))


def matched(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node, to): each node's group, the smaller number of its pair. No pair weighs more
    than ``most``."""
    one, two = (nodes.select(F.col("node").alias(k), F.col("weight").alias(f"w{k}")) for k in "uv")
    open_ = edges.join(one, "u").join(two, "v").where(F.col("wu") + F.col("wv") <= most).select("u", "v", "w")
    # a pair looks the same from both ends, so some pair is the best of both
    tie = F.pmod(mixed(F.col("u"), 17) + mixed(F.col("v"), 17), F.lit(2147483647))
    choice = materialise(_both(open_).groupBy("u").agg(F.max_by("v", F.struct("w", tie.alias("t"), F.least("u", "v").alias("l"))).alias("v")))
    back = choice.select(F.col("v").alias("u"), F.col("u").alias("v"))
    pairs = materialise(choice.join(back, ["u", "v"]).where("u < v").select("u", "v"))
    taken = pairs.select(F.explode(F.array("u", "v")).alias("u"))
    # what one node has turned down pairs up in its order
    left = choice.join(taken, "u", "left_anti").join(one, "u").where(2 * F.col("wu") <= most).select("u", F.col("v").alias("hub"))
    placed = running_in(left, "hub", ["u"], "n")
    couples = placed.groupBy("hub", F.floor(F.col("n") / 2).alias("k")).agg(F.min("u").alias("u"), F.max("u").alias("v")).where("u < v").select("u", "v")
    groups = pairs.union(couples).select(F.explode(F.array("u", "v")).alias("node"), F.col("u").alias("to"))
    out = materialise(nodes.join(groups, "node", "left").select("node", F.coalesce("to", "node").alias("to")))
    discard(choice, pairs)
    return out


def contracted(nodes: DataFrame, edges: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the groups."""
    heavier = nodes.join(to, "node").groupBy(F.col("to").alias("node")).agg(F.sum("weight").alias("weight"))
    one, two = (to.select(F.col("node").alias(k), F.col("to").alias(f"t{k}")) for k in "uv")
    moved = edges.join(one, "u").join(two, "v").where("tu != tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"), "w")
    return materialise(heavier), materialise(moved.groupBy("u", "v").agg(F.sum("w").alias("w")))


def _held(both: DataFrame, at: DataFrame) -> DataFrame:
    """(u, part, w): edge weight of each node with each part, from edges in both directions."""
    return both.join(at.select(F.col("node").alias("v"), "part"), "v").groupBy("u", "part").agg(F.sum("w").alias("w"))


def _room(at: DataFrame, parts: int, limit: float) -> DataFrame:
    """(to, room): a row for each part."""
    sizes = at.groupBy("part").agg(F.sum("weight").alias("size"))
    every = at.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    return every.join(sizes, "part", "left").select(F.col("part").alias("to"), (F.lit(limit) - F.coalesce("size", F.lit(0))).alias("room"))


def refined(at: DataFrame, edges: DataFrame, parts: int, limit: float, rounds: int, seed: int = 0) -> DataFrame:
    """(node, weight, part) after ``rounds`` rounds of moves that lower the cut, or as soon
    as no node wants to move either way."""
    # every round reads a node's edges in one place, and shuffles a row for each node and part
    both = materialise(_both(edges).repartition("u").sortWithinPartitions("u"))
    idle = 0
    for r in range(rounds):
        here = at.select(F.col("node").alias("u"), F.col("part").alias("own"), "weight")
        held = _held(both, at).join(here, "u")
        way = F.col("part") > F.col("own") if r % 2 == 0 else F.col("part") < F.col("own")
        best = held.groupBy("u").agg(F.max(F.when(F.col("part") == F.col("own"), F.col("w"))).alias("stay"), F.max(F.when(way, F.struct("w", (-F.col("part")).alias("p")))).alias("go"), F.first("weight").alias("weight"))
        moves = best.where(F.col("go.w") > F.coalesce("stay", F.lit(0))).select(F.col("u").alias("node"), (-F.col("go.p")).alias("to"), "weight", F.pmod(mixed(F.col("u"), 101 + 7 * r + seed), F.lit(1 << 20)).alias("turn"))
        moves = materialise(moves)
        if moves.isEmpty():
            discard(moves)
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        # one row for each part
        share = moves.groupBy("to").agg(F.sum("weight").alias("asked")).join(F.broadcast(_room(at, parts, limit)), "to").select("to", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("room") / F.col("asked"))).alias("share"))
        go = moves.join(F.broadcast(share), "to").where(F.col("turn") < F.col("share") * (1 << 20)).select("node", "to")
        moved = at.join(go, "node", "left").select("node", "weight", F.coalesce("to", "part").alias("part"))
        at = materialise(moved, replaces=at)
        discard(moves)
    discard(both)
    return at


def balanced(at: DataFrame, edges: DataFrame, parts: int, limit: int) -> DataFrame:
    """Parts of more than ``limit`` nodes of weight one give up what they have too much:
    the nodes that lose least by it, dealt into the room of the others."""
    room = materialise(_room(at, parts, limit))
    if room.where("room < 0").isEmpty():
        return at
    own = _held(_both(edges), at).join(at.select(F.col("node").alias("u"), F.col("part").alias("own")), "u").where("part = own").select(F.col("u").alias("node"), "w")
    ranked = running_in(at.join(own, "node", "left").select("node", "part", F.coalesce("w", F.lit(0)).alias("w")), "part", ["w", "node"], "n")
    leave = ranked.join(F.broadcast(room.where("room < 0").select(F.col("to").alias("part"), (-F.col("room")).alias("over"))), "part").where("n < over").select("node", F.lit(0).alias("one"))
    numbered = materialise(running_in(leave, "one", ["node"], "k"))
    # a row for each part with its stretch of the numbers
    free = room.where("room > 0").select("to", "room", F.coalesce(F.sum("room").over(Window.orderBy("to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    given = numbered.join(F.broadcast(free), (F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("room"))).select("node", "to")
    return materialise(at.join(given, "node", "left").select("node", "weight", F.coalesce("to", "part").alias("part")))


def multilevel(edges: DataFrame, parts: int, slack: float = 1.1, coarsest: int | None = None, rounds: int = 4, levels: int = 40) -> DataFrame:
    """(node, part): few edges between parts, and no part with more than ``slack`` times
    its share of the nodes (rounded up)."""
    nodes, links = graph_of(edges)
    total = nodes.count()
    enough = coarsest or 12 * parts
    most = max(2, int(total / (4 * parts)))
    stack, n = [], total
    while n > enough and len(stack) < levels:
        to = matched(nodes, links, most)
        smaller = contracted(nodes, links, to)
        m = smaller[0].count()
        if m > 0.97 * n:
            break
        stack.append((nodes, links, to))
        nodes, links, n = *smaller, m
    limit = -(-total * slack // parts)
    starts = [materialise(nodes.withColumn("part", hashed(F.col("node") + F.lit(seed), parts))) for seed in (0, 1)]
    tried = [refined(at, links, parts, limit, rounds + 2, seed) for seed, at in enumerate(starts)]
    cuts = [links.join(at.select(F.col("node").alias("u"), F.col("part").alias("a")), "u").join(at.select(F.col("node").alias("v"), F.col("part").alias("b")), "v").agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("w"))), F.lit(0))).first()[0] for at in tried]
    at = tried[min(range(len(cuts)), key=cuts.__getitem__)]
    while stack:
        nodes, links, to = stack.pop()
        finer = to.join(at.select(F.col("node").alias("to"), "part"), "to").join(nodes, "node").select("node", "weight", "part")
        at = refined(materialise(finer), links, parts, limit, rounds)
    return balanced(at, links, parts, int(limit)).select("node", "part")
