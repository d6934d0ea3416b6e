"""A vertex cut of a stream of edges, placed greedily in micro-batches.

Each batch sees what the ones before have left: the parts that hold a copy of a node, its
degree, which decays with time, and the number of edges of each part. An edge goes where
its ends have copies, the end of the smaller degree counting more, and where there are few
edges; edges of nodes that no part holds yet go by a hash of their rarer end, so that they
stay together. Only the loads, one number for each part, pass through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.partitioning import hashed
from chronoloom.scratch import discard, materialise


def _score(p: int, load: int, low: int, high: int, balance: float, share: Column) -> Column:
    """What part p is worth to an edge: for each end with a copy there one, and more the
    smaller its share of both degrees; and room."""
    copy = lambda end, own: F.when(F.array_contains(f"{end}_parts", p), 2.0 - own).otherwise(0.0)
    room = balance * (high - load) / (1.0 + high - low)
    return F.round(copy("src", share) + copy("dst", 1.0 - share) + F.lit(room), 9)


def streaming_cut(numbered: DataFrame, parts: int, batches: int = 16, decay: float = 0.0, balance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((node, parts, degree), (eid, part)): the parts that hold a copy of each node, and
    that of each edge. numbered: (eid, src, dst, ts, rn) in order of time; a node's degree
    falls by exp(-decay * time) between batches."""
    total = numbered.count()
    per = max(1, -(-total // batches))
    spark = numbered.sparkSession
    state = spark.createDataFrame([], "node long, parts array<int>, degree double, seen double")
    loads, placed = [0] * parts, None
    for b in range(-(-total // per)):
        rows = numbered.where((F.col("rn") >= b * per) & (F.col("rn") < (b + 1) * per)).select("eid", "src", "dst", "ts")
        now = F.lit(float(rows.agg(F.max("ts")).first()[0]))
        ends = rows.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        degree = F.coalesce(F.col("degree") * F.exp(-decay * (now - F.col("seen"))), F.lit(0.0)) + F.col("n")
        known = materialise(ends.join(state, "node", "left").select("node", F.coalesce("parts", F.array().cast("array<int>")).alias("parts"), F.round(degree, 9).alias("degree")))
        side = lambda k: known.select(F.col("node").alias(k), F.col("parts").alias(f"{k}_parts"), F.col("degree").alias(f"{k}_degree"))  # noqa: B023, E731
        both = rows.join(side("src"), "src").join(side("dst"), "dst")
        share = F.col("src_degree") / (F.col("src_degree") + F.col("dst_degree"))
        low, high = min(loads), max(loads)
        best = F.greatest(*[F.struct(_score(p, loads[p], low, high, balance, share).alias("s"), F.lit(-p).alias("p")) for p in range(parts)])
        rare = F.when(F.col("src_degree") <= F.col("dst_degree"), F.col("src")).otherwise(F.col("dst"))
        fresh = (F.size("src_parts") == 0) & (F.size("dst_parts") == 0)
        out = materialise(both.select("eid", "src", "dst", F.when(fresh, hashed(rare, parts)).otherwise((-best["p"]).cast("int")).alias("part")))
        for r in out.groupBy("part").count().collect():  # a row for each part
            loads[r["part"]] += r["count"]
        copies = out.select(F.explode(F.array("src", "dst")).alias("node"), "part").groupBy("node").agg(F.collect_set("part").alias("more"))  # no more than there are parts
        changed = known.join(copies, "node").select("node", F.array_sort(F.array_union("parts", "more")).alias("parts"), "degree", now.alias("seen"))
        kept = materialise(state.join(changed, "node", "left_anti").unionByName(changed))
        discard(known, *([state] if b else []))
        state = kept
        placed = out if placed is None else placed.unionByName(out)
    if placed is None:
        placed = spark.createDataFrame([], "eid long, src long, dst long, part int")
    return state.select("node", "parts", "degree"), placed.select("eid", "part")
