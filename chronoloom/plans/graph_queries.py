"""Queries over the given tables, and the SQL they are held against.

``query(name, sql)`` registers a function (spark, sf_dir) -> DataFrame with its SQL, or
without one where SQL has no form of it. Derived doubles are rounded on both sides, as
sums depend on the order of their terms in the last bits."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import metrics as mt
from chronoloom.operators import events as ev
from chronoloom.operators import messages as ms
from chronoloom.operators import multilevel as ml
from chronoloom.operators import partitioning as pt
from chronoloom.operators import sampling as sp
from chronoloom.operators import snapshots as sn
from chronoloom.operators import state as st
from chronoloom.operators import temporal as tp
from chronoloom.operators import vertex_cut as vc
from chronoloom.plans import epoch_queries as eq
from chronoloom.plans.datasets import load_dataset
from chronoloom.plans.session import Session
from chronoloom.scratch import materialise, shared_folder, ship_package
from chronoloom.sources import artifacts
from chronoloom.sources import edges as src
from chronoloom.sources.adjacency import Adjacency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SNAPS, BATCH, PARTS, SLOTS, K = 8, 200, 4, 3, 5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def graph(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    return src.event_graph(table(spark, sf, "events"), *more)


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return ev.with_row_number(graph(spark, sf), "ts", "eid")


def snapped(spark: SparkSession, sf: str) -> DataFrame:
    return sn.equal_count(numbered(spark, sf), SNAPS)


def split(spark: SparkSession, sf: str) -> DataFrame:
    return ev.event_batches(ev.assign_splits(numbered(spark, sf)), BATCH)


def supply(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers to parts with an id that is unique and follows the rows' own values."""
    item = table(spark, sf, "lineitem")
    eid = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return src.supply_graph(item).withColumn("eid", eid).groupBy("eid").agg(F.min(F.struct("ts", "src", "dst", "weight")).alias("e")).select("eid", "e.src", "e.dst", "e.ts", "e.weight")


def node_parts(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph(spark, sf).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.withColumn("part", pt.round_robin(F.col("node"), PARTS))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).select("eid", F.round("weight", 1).alias("score"), (F.col("eid") % 3 == 0).cast("int").alias("label"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


EV = """ev AS (SELECT event_id AS eid, user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1000000 AS dst,
    epoch_us(ts) AS ts, value AS weight, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events)"""
TOTAL = "tot AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.7) AS BIGINT) AS a, CAST(floor(count(*) * 0.15) AS BIGINT) AS b FROM ev)"
SPLIT = f"""{EV}, {TOTAL}, sp AS (SELECT ev.*, CASE WHEN rn < a THEN 'train' WHEN rn < a + b THEN 'val' ELSE 'test' END AS split,
    rn - CASE WHEN rn < a THEN 0 WHEN rn < a + b THEN a ELSE a + b END AS rn_in_split FROM ev, tot),
    ba AS (SELECT *, CAST(floor(rn_in_split / {BATCH}) AS BIGINT) AS batch FROM sp)"""
SNAP = f"{EV}, sn AS (SELECT *, CAST(floor(rn / ceil((SELECT count(*) FROM ev) / {SNAPS}.0)) AS BIGINT) AS snap FROM ev)"
DEG = """deg AS (SELECT snap, node, sum(i) AS in_deg, sum(o) AS out_deg FROM (SELECT snap, src AS node, 0.0::DOUBLE AS i, weight AS o FROM sn
    UNION ALL SELECT snap, dst, weight, 0.0::DOUBLE FROM sn) GROUP BY ALL)"""
SUP = """sup AS (SELECT eid, e.src AS src, e.dst AS dst, e.ts AS ts, e.weight AS weight FROM (SELECT l_orderkey * 8 + l_linenumber AS eid,
    min({'ts': epoch_us(l_shipdate), 'src': l_suppkey, 'dst': l_partkey + 1000000000, 'weight': l_quantity}) AS e FROM lineitem GROUP BY ALL))"""
PART = f"{EV}, pn AS (SELECT DISTINCT node, CAST(node % {PARTS} AS INTEGER) AS part FROM (SELECT src AS node FROM ev UNION ALL SELECT dst FROM ev))"
ENDS = f"{PART}, en AS (SELECT ev.*, CAST(src % {PARTS} AS INTEGER) AS sp, CAST(dst % {PARTS} AS INTEGER) AS dp FROM ev)"
HALO = f"{ENDS}, ha AS (SELECT DISTINCT dp AS part, src AS node, sp AS owner FROM en WHERE sp <> dp)"
LOCAL = f"""{HALO}, li AS (SELECT part, node, is_halo, row_number() OVER (PARTITION BY part ORDER BY is_halo, owner, node) - 1 AS local FROM
    (SELECT part, node, FALSE AS is_halo, -1 AS owner FROM pn UNION ALL SELECT part, node, TRUE, owner FROM ha))"""
MAIL = f"""{SPLIT}, tr AS (SELECT * FROM ba WHERE split = 'train'), ma AS (SELECT batch, eid, ts, src AS node, dst AS peer, 0 AS side FROM tr UNION ALL SELECT batch, eid, ts, dst, src, 1 FROM tr),
    ca AS (SELECT node, batch, side, count(*) AS n, max({{'ts': ts, 'eid': eid, 'peer': peer}}) AS last FROM ma GROUP BY ALL),
    wr AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY node ORDER BY batch, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) % {SLOTS} AS slot FROM ca)"""
SCORED = "sc AS (SELECT event_id AS eid, round(value, 1) AS score, CAST(event_id % 3 = 0 AS INTEGER) AS label FROM events)"


# Sources

@query("edges_canonical", f"WITH {EV} SELECT eid, src, dst, ts, weight FROM ev")
def edges_canonical(spark, sf):
    return graph(spark, sf)


@query("edge_lines", """SELECT l_suppkey AS src, l_partkey AS dst, CAST(l_linenumber AS DOUBLE) AS ts,
    CASE WHEN l_orderkey % 3 = 1 THEN l_quantity ELSE 1.0 END AS weight FROM lineitem""")
def edge_lines(spark, sf):
    s, d, w, t = (F.col(c).cast("string") for c in ("l_suppkey", "l_partkey", "l_quantity", "l_linenumber"))
    kind = F.col("l_orderkey") % 3
    line = F.when(kind == 0, F.concat_ws(" ", s, d, t)).when(kind == 1, F.concat_ws(",", s, d, w, t)).otherwise(F.concat_ws("  ", F.lit("9"), s, d, t, w))
    extra = table(spark, sf, "region").select(F.concat(F.lit("% "), "r_name").alias("value"))
    return src.parse_edge_lines(table(spark, sf, "lineitem").select(line.alias("value")).union(extra))


@query("edge_table_inferred", "SELECT l_suppkey AS src, l_partkey AS dst, CAST(l_orderkey AS DOUBLE) AS ts, l_quantity AS weight FROM lineitem")
def edge_table_inferred(spark, sf):
    named = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w"), F.col("l_orderkey").alias("seen"))
    return src.edges_from_table(named)


@query("node_features", "SELECT c_custkey AS node, 0.0::DOUBLE AS ts, CAST(c_nationkey AS DOUBLE) AS f0, c_acctbal AS f1 FROM customer")
def node_features(spark, sf):
    feats = src.node_features(table(spark, sf, "customer").withColumnRenamed("c_custkey", "node_id"))
    return feats.select("node", "ts", F.col("feat")[0].alias("f0"), F.col("feat")[1].alias("f1"))


# Ids, order, splits

@query("edges_remap", f"""WITH {EV}, ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev))
    SELECT ev.eid, a.id AS src, b.id AS dst FROM ev JOIN ids a ON ev.src = a.node JOIN ids b ON ev.dst = b.node""")
def edges_remap(spark, sf):
    g = graph(spark, sf)
    return ev.remap(g, ev.node_ids(g)).select("eid", "src", "dst")


@query("features_remap", f"""WITH {EV}, ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev))
    SELECT id AS node, c_acctbal FROM customer JOIN ids ON c_custkey = node""")
def features_remap(spark, sf):
    return ev.remap_features(table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), "c_acctbal"), ev.node_ids(graph(spark, sf)))


@query("row_number_ranged", f"WITH {EV} SELECT eid, rn FROM ev")
def row_number_ranged(spark, sf):
    return ev.with_row_number(graph(spark, sf), "ts", "eid", ranges=16).select("eid", "rn")


@query("skiptime", f"WITH {SUP}, d AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS r FROM sup) SELECT eid, src, dst, ts FROM d WHERE r > 30")
def skiptime(spark, sf):
    return ev.after_skiptime(supply(spark, sf), 30).select("eid", "src", "dst", "ts")


@query("split_assign", f"WITH {SPLIT} SELECT eid, split, rn_in_split FROM sp")
def split_assign(spark, sf):
    return ev.assign_splits(numbered(spark, sf)).select("eid", "split", "rn_in_split")


@query("event_batches", f"WITH {SPLIT} SELECT split, batch, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM ba GROUP BY ALL")
def event_batches(spark, sf):
    return split(spark, sf).groupBy("split", "batch").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))


@query("batch_plan", f"""WITH {SPLIT}, e AS (SELECT split, src % {PARTS} AS part, count(*) AS n FROM ba GROUP BY ALL)
    SELECT split, CAST(sum(n) AS BIGINT) AS events, min(n) AS min_local, max(n) AS max_local FROM e GROUP BY split""")
def batch_plan(spark, sf):
    return ev.batch_plan(split(spark, sf), pt.round_robin(F.col("src"), PARTS))


@query("visible_graph", f"WITH {SPLIT} SELECT eid, src, dst FROM sp WHERE split IN ('train', 'val')")
def visible_graph(spark, sf):
    return ev.visible_to(split(spark, sf), "val").select("eid", "src", "dst")


@query("owned_events", f"WITH {EV} SELECT eid, src FROM ev WHERE src % {PARTS} = 1")
def owned_events(spark, sf):
    return ev.owned(graph(spark, sf), pt.round_robin(F.col("src"), PARTS), 1).select("eid", "src")


@query("index_packing", f"WITH {EV} SELECT eid, dst | ((src % {PARTS}) << 48) | ((eid % 2) << 62) AS packed, dst AS loc, CAST(src % {PARTS} AS INTEGER) AS part, eid % 2 = 1 AS shared FROM ev")
def index_packing(spark, sf):
    packed = graph(spark, sf).select("eid", ev.pack_index(F.col("dst"), F.col("src") % PARTS, F.col("eid") % 2).alias("packed"))
    loc, part, shared = ev.unpack_index(F.col("packed"))
    return packed.select("eid", "packed", loc.alias("loc"), part.alias("part"), shared.alias("shared"))


@query("feature_width", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, CAST(70 AS INTEGER) AS width, 0.0::DOUBLE AS last FROM embeddings")
def feature_width(spark, sf):
    wide = table(spark, sf, "embeddings").withColumn("f", ev.fit_width(F.col("embedding").cast("array<double>"), 70))
    return wide.select("vec_id", F.round(F.col("f")[0], 6).alias("first"), F.size("f").alias("width"), F.col("f")[69].alias("last"))


# Snapshots

@query("snapshot_equal_count", f"WITH {SNAP} SELECT snap, count(*) AS n, round(sum(weight), 6) AS weight FROM sn GROUP BY ALL")
def snapshot_equal_count(spark, sf):
    return snapped(spark, sf).groupBy("snap").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("snapshot_stats", f"WITH {SNAP} SELECT s.snap, count(eid) AS n_edges, min(ts) AS t_start, max(ts) AS t_end FROM (SELECT unnest(range({SNAPS})) AS snap) s LEFT JOIN sn ON s.snap = sn.snap GROUP BY ALL")
def snapshot_stats(spark, sf):
    return sn.snapshot_stats(snapped(spark, sf), SNAPS)


@query("snapshot_end_ts", f"WITH {SNAP} SELECT snap, max(ts) AS end_ts FROM sn GROUP BY ALL")
def snapshot_end_ts(spark, sf):
    return sn.snapshot_ends(snapped(spark, sf), SNAPS)


@query("snapshot_degrees", f"WITH {SNAP}, {DEG} SELECT snap, node, round(in_deg, 6) AS in_deg, round(out_deg, 6) AS out_deg, round(ln(1 + in_deg), 6) AS label FROM deg")
def snapshot_degrees(spark, sf):
    return rounded(sn.degrees(snapped(spark, sf)), "in_deg", "out_deg", "label")


@query("snapshot_labels", f"WITH {SNAP}, {DEG} SELECT snap, node, CASE WHEN snap < {SNAPS} - 1 THEN round(ln(1 + in_deg), 6) END AS label FROM deg")
def snapshot_labels(spark, sf):
    return sn.degrees(snapped(spark, sf)).select("snap", "node", F.when(F.col("snap") < SNAPS - 1, F.round("label", 6)).alias("label"))


@query("window_masked", f"""WITH {EV}, b AS (SELECT min(ts) AS t0, greatest(min(ts) + 1, max(ts)) AS t1 FROM ev), w AS (SELECT t0, greatest(1.0, (t1 - t0)::DOUBLE / 20) AS itv FROM b),
    h AS (SELECT i, eid, weight FROM ev, w, (SELECT unnest(range(17)) AS i) WHERE ts >= t0 + i * itv AND ts < t0 + (i + 4) * itv)
    SELECT dense_rank() OVER (ORDER BY i) - 1 AS snap, count(*) AS n, round(sum(weight), 6) AS weight FROM h GROUP BY i""")
def window_masked(spark, sf):
    return sn.masked_windows(graph(spark, sf), 20, 3).groupBy("snap").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("window_batch", f"WITH {EV} SELECT CAST(floor(rn / 300) AS BIGINT) AS snap, count(*) AS n, max(ts) AS end_ts FROM ev GROUP BY ALL")
def window_batch(spark, sf):
    return sn.fixed_batches(numbered(spark, sf), 300).groupBy("snap").agg(F.count("*").alias("n"), F.max("ts").alias("end_ts"))


@query("snapshot_normalised", f"""WITH {SNAP} SELECT s.snap, count(*) AS n FROM (SELECT unnest(range({SNAPS + 3})) AS snap) s JOIN sn ON sn.snap = least(s.snap, {SNAPS - 1}) GROUP BY ALL""")
def snapshot_normalised(spark, sf):
    return sn.normalised_count(snapped(spark, sf), SNAPS, SNAPS + 3).groupBy("snap").agg(F.count("*").alias("n"))


@query("warmup_tags", f"WITH {SNAP} SELECT snap, count(*) AS n, CASE WHEN snap < 5 THEN 'snapshot_warmup' ELSE 'snapshot_val' END AS chain FROM sn GROUP BY ALL")
def warmup_tags(spark, sf):
    return sn.warmup_tags(snapped(spark, sf), 5, "val").groupBy("snap", "chain").agg(F.count("*").alias("n"))


@query("model_windows", f"WITH {SNAP}, s AS (SELECT snap, count(*) AS n FROM sn GROUP BY ALL) SELECT a.snap AS at, b.snap, a.snap - b.snap AS age, b.n FROM s a JOIN s b ON b.snap BETWEEN a.snap - 2 AND a.snap")
def model_windows(spark, sf):
    sizes = snapped(spark, sf).groupBy("snap").agg(F.count("*").alias("n"))
    return sn.model_windows(sizes.select("snap"), 3).join(sizes, "snap").select("at", "snap", "age", "n")


NOVEL = f"""{EV}, lg AS (SELECT eid, CAST(floor(rn / {BATCH}) AS BIGINT) AS batch, coalesce(rn - lag(rn) OVER (PARTITION BY src, dst ORDER BY rn) <= 500, FALSE) AS again FROM ev),
    un AS (SELECT batch, greatest(0, CAST(round((count(*) FILTER (NOT again) - 0.5 * count(*) FILTER (again)) * 1000 / count(*)) AS BIGINT)) AS units FROM lg GROUP BY batch),
    sl AS (SELECT batch, units, CAST(floor(coalesce(sum(units) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000.0) AS BIGINT) AS slice FROM un)"""


@query("novelty_slices", f"WITH {NOVEL} SELECT batch, units / 1000.0::DOUBLE AS score, slice FROM sl")
def novelty_slices(spark, sf):
    return sn.novelty_cuts(numbered(spark, sf), BATCH, aggl=1.0, window_size=500)


@query("novelty_events", f"WITH {NOVEL} SELECT eid, slice, NOT (again AND ((eid % 2147483647) * 48271 + 13) % 2147483647 < {int(0.3 * 2147483647)}) AS kept FROM lg JOIN sl USING (batch)")
def novelty_events(spark, sf):
    """Each event with its slice, and whether it is kept where repeated ones are thinned."""
    return sn.novelty_events(numbered(spark, sf), BATCH, aggl=1.0, drop_rate=0.3, window_size=500).select("eid", "slice", "kept")


@query("lifetime_graph", f"WITH {SNAP} SELECT src, dst, count(*) AS n, round(sum(weight), 6) AS weight FROM sn GROUP BY ALL")
def lifetime_graph(spark, sf):
    return snapped(spark, sf).drop("snap").groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("snapshot_range", f"WITH {SNAP} SELECT eid, snap - 2 AS snap FROM sn WHERE snap BETWEEN 2 AND 4")
def snapshot_range(spark, sf):
    return snapped(spark, sf).where("snap between 2 and 4").select("eid", (F.col("snap") - 2).alias("snap"))


# Lookups in time

@query("asof_features", """WITH q AS (SELECT event_id AS eid, user_id AS node, epoch_us(ts) AS ts FROM events WHERE event_type = 'purchase'),
    h AS (SELECT user_id AS node, epoch_us(ts) AS ts, event_id AS seen, value FROM events WHERE event_type = 'click')
    SELECT q.eid, q.node, q.ts, h.seen, h.value FROM q ASOF LEFT JOIN h ON q.node = h.node AND q.ts >= h.ts""")
def asof_features(spark, sf):
    q, h = _histories(spark, sf)
    return tp.asof(q, h, "node", "ts", ["seen", "value"], "seen")


def _histories(spark, sf):
    e = graph(spark, sf, F.col("event_type")).withColumnRenamed("src", "node")
    return e.where("event_type = 'purchase'").select("eid", "node", "ts"), e.where("event_type = 'click'").select("node", "ts", F.col("eid").alias("seen"), F.col("weight").alias("value"))


@query("asof_salted", ORACLES["asof_features"])
def asof_salted(spark, sf):
    q, h = _histories(spark, sf)
    return tp.asof_salted(q, h, "node", "ts", ["seen", "value"], 86_400_000_000, "seen")


@query("asof_snapshot", f"""WITH {SNAP}, en AS (SELECT snap, max(ts) AS ts FROM sn GROUP BY ALL), q AS (SELECT snap, node, ts FROM en, (SELECT DISTINCT src AS node FROM ev)),
    h AS (SELECT user_id AS node, epoch_us(ts) AS ts, value FROM events WHERE event_type = 'click')
    SELECT q.snap, q.node, q.ts, coalesce(h.value, 0.0) AS value FROM q ASOF LEFT JOIN h ON q.node = h.node AND q.ts >= h.ts""")
def asof_snapshot(spark, sf):
    _, h = _histories(spark, sf)
    g = snapped(spark, sf)
    ends = F.broadcast(sn.snapshot_ends(g, SNAPS).withColumnRenamed("end_ts", "ts"))  # one row for each snapshot
    nodes = g.select(F.col("src").alias("node")).distinct()
    asked = nodes.withColumn("snap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SNAPS - 1).cast("long")))).join(ends, "snap")
    return tp.asof(asked, h, "node", "ts", ["value"]).select("snap", "node", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))


RECENT = """SELECT a.eid AS root_eid, a.src AS root, b.eid AS nbr_eid, b.dst AS nbr, a.ts - b.ts AS dt,
    row_number() OVER (PARTITION BY a.eid ORDER BY b.ts DESC, b.eid DESC) AS rank FROM {t} a JOIN {t} b ON a.src = b.src AND b.ts < a.ts"""


@query("recent_k", f"WITH {EV}, r AS ({RECENT.format(t='ev')}) SELECT * FROM r WHERE rank <= {K}")
def recent_k(spark, sf):
    return tp.recent_k(graph(spark, sf), K)


@query("recent_k_ties", f"WITH {SUP}, r AS ({RECENT.format(t='sup')}) SELECT * FROM r WHERE rank <= {K}")
def recent_k_ties(spark, sf):
    return tp.recent_k(supply(spark, sf), K)


ROOTS = f"{SPLIT}, last AS (SELECT batch, max(ts) AS root_ts FROM ba WHERE split = 'val' GROUP BY ALL), ro AS (SELECT DISTINCT root, root_ts FROM (SELECT batch, src AS root FROM ba WHERE split = 'val' UNION SELECT batch, dst FROM ba WHERE split = 'val') JOIN last USING (batch))"
OF_ROOTS = """SELECT {r}.root, {r}.root_ts, ev.eid AS nbr_eid, ev.dst AS nbr, {r}.root_ts - ev.ts AS dt,
    row_number() OVER (PARTITION BY {r}.root, {r}.root_ts ORDER BY ev.ts DESC, ev.eid DESC) AS rank FROM {r} JOIN ev ON ev.src = {r}.root AND ev.ts < {r}.root_ts"""


def _val_roots(spark, sf):
    return tp.batch_roots(split(spark, sf).where("split = 'val'")).select("root", "root_ts")


@query("recent_k_batch_max", f"WITH {ROOTS}, r AS ({OF_ROOTS.format(r='ro')}) SELECT * FROM r WHERE rank <= {K}")
def recent_k_batch_max(spark, sf):
    return tp.recent_k_of(_val_roots(spark, sf), graph(spark, sf), K)


BOTH = EV.replace("ev AS (", "e0 AS (") + ", ev AS (SELECT eid * 2 AS eid, src, dst, ts FROM e0 UNION ALL SELECT eid * 2 + 1, dst, src, ts FROM e0)"
TWO_HOP = f"""WITH {BOTH}, ro AS (SELECT DISTINCT src AS root, ts AS root_ts FROM ev WHERE eid % 100 = 0), h1 AS (SELECT * FROM ({OF_ROOTS.format(r='ro')}) WHERE rank <= 3),
    r2 AS (SELECT DISTINCT nbr AS root, root_ts FROM h1), h2 AS (SELECT * FROM ({OF_ROOTS.format(r='r2')}) WHERE rank <= 2)"""


def _two_hop(spark, sf):
    g = graph(spark, sf)
    both = g.select((F.col("eid") * 2).alias("eid"), "src", "dst", "ts").union(g.select(F.col("eid") * 2 + 1, "dst", "src", "ts"))
    return tp.hops(both, both.where("eid % 100 = 0").select(F.col("src").alias("root"), F.col("ts").alias("root_ts")), [3, 2])


@query("two_hop", TWO_HOP + " SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2")
def two_hop(spark, sf):
    return _two_hop(spark, sf).withColumn("hop", F.col("hop").cast("int"))


@query("sample_unique_nodes", TWO_HOP + " SELECT DISTINCT nbr FROM (SELECT nbr FROM h1 UNION ALL SELECT nbr FROM h2)")
def sample_unique_nodes(spark, sf):
    return _two_hop(spark, sf).select("nbr").distinct()


def _two_hop_events(spark, sf):
    """As ``_two_hop``, from both ends of every event."""
    g = graph(spark, sf)
    both = g.select((F.col("eid") * 2).alias("eid"), "src", "dst", "ts").union(g.select(F.col("eid") * 2 + 1, "dst", "src", "ts"))
    return tp.hops(both, both.select(F.col("src").alias("root"), F.col("ts").alias("root_ts")), [3, 2])


# Without SQL: the inequality join over every event is too slow. A test has brute force.
@query("two_hop_events")
def two_hop_events(spark, sf):
    return _two_hop_events(spark, sf).withColumn("hop", F.col("hop").cast("int"))


@query("sample_unique_nodes_events")
def sample_unique_nodes_events(spark, sf):
    return _two_hop_events(spark, sf).select("nbr").distinct()


@query("uniform_k", f"""WITH {EV}, o AS (SELECT eid, src, row_number() OVER (PARTITION BY src ORDER BY ts, eid) AS k, rank() OVER (PARTITION BY src ORDER BY ts) - 1 AS before FROM ev),
    d AS (SELECT eid AS root_eid, src, before, draw FROM o, (SELECT unnest(range(1, 4)) AS draw) WHERE before > 0)
    SELECT root_eid, o.eid AS nbr_eid, draw FROM d JOIN o ON o.src = d.src AND o.k = (((root_eid * 3 + draw) * 48271 + 7) % 2147483647) % d.before + 1""")
def uniform_k(spark, sf):
    return tp.uniform_k(graph(spark, sf), 3)


UNIFORM = """SELECT {r}.root, {r}.root_ts, b.eid AS nbr_eid, b.dst AS nbr, {r}.root_ts - b.ts AS dt, rank FROM (SELECT c.root, c.root_ts, rank, ((((c.root % 2147483647) * 31 + c.root_ts % 2147483647) % 2147483647) * 48271 + rank * 7919 + 7) % 2147483647 % c.n AS n
    FROM (SELECT {r}.root, {r}.root_ts, count(*) AS n FROM {r} JOIN ev ON ev.src = {r}.root AND ev.ts < {r}.root_ts GROUP BY ALL) c, (SELECT unnest(range(1, {k} + 1)) AS rank)) {r} JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, eid) - 1 AS i FROM ev) b ON b.src = {r}.root AND b.i = {r}.n"""
UNIFORM_HOPS = f"{ROOTS}, h1 AS ({UNIFORM.format(r='ro', k=3)}), rt AS (SELECT DISTINCT nbr - 1000000 AS root, root_ts FROM h1), h2 AS ({UNIFORM.format(r='rt', k=2)})"


@query("uniform_two_hop", f"WITH {UNIFORM_HOPS} SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2")
def uniform_two_hop(spark, sf):
    """Uniform draws in both hops; the second starts at the users whose id is a target's key."""
    g, roots = graph(spark, sf), _val_roots(spark, sf)
    first = tp.hops(g, roots, [3], tp.uniform_k_of)
    second = tp.hops(g, first.select((F.col("nbr") - 1_000_000).alias("root"), "root_ts"), [2], tp.uniform_k_of).withColumn("hop", F.lit(2))
    return first.withColumn("hop", F.col("hop").cast("int")).unionByName(second.withColumn("hop", F.col("hop").cast("int")))


@query("distinct_local_k", f"WITH {ROOTS}, lo AS (SELECT * FROM ev WHERE dst % {PARTS} = 1), r AS ({OF_ROOTS.format(r='ro').replace('ev.', 'lo.').replace('JOIN ev', 'JOIN lo')}), d AS (SELECT *, row_number() OVER (PARTITION BY root, root_ts, nbr ORDER BY rank) AS k FROM r WHERE rank <= {K}) SELECT root, root_ts, nbr_eid, nbr, dt, rank FROM d WHERE k = 1")
def distinct_local_k(spark, sf):
    """The latest neighbours that one part owns, each once."""
    local = tp.of_part(graph(spark, sf), node_parts(spark, sf), 1)
    return tp.each_neighbour_once(tp.recent_k_of(_val_roots(spark, sf), local, K))


@query("delta_time", f"WITH {EV}, r AS ({RECENT.format(t='ev')}) SELECT root, count(*) AS n, CAST(sum(dt) AS BIGINT) AS dt FROM r WHERE rank <= {K} GROUP BY ALL")
def delta_time(spark, sf):
    return tp.recent_k(graph(spark, sf), K).groupBy("root").agg(F.count("*").alias("n"), F.sum("dt").alias("dt"))


@query("time_encode", f"WITH {EV} SELECT eid, i, round(cos(CAST(rn AS DOUBLE) * pow(10.0, -9.0 * i / 7)), 6) AS x FROM ev, (SELECT CAST(unnest(range(8)) AS INTEGER) AS i)")
def time_encode(spark, sf):
    return numbered(spark, sf).select("eid", F.posexplode(tp.time_encoding(F.col("rn").cast("double"), 8)).alias("i", "x")).withColumn("x", F.round("x", 6))


# Partitions

@query("parts_round_robin", f"WITH {PART} SELECT node, part FROM pn")
def parts_round_robin(spark, sf):
    return node_parts(spark, sf)


@query("parts_range", f"""WITH {EV}, ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev))
    SELECT node, CAST(floor(id * {PARTS} / (SELECT count(*) FROM ids)) AS INTEGER) AS part FROM ids""")
def parts_range(spark, sf):
    ids = ev.node_ids(graph(spark, sf))
    return ids.select("node", pt.contiguous(F.col("id"), ids.count(), PARTS).alias("part"))


@query("part_sizes", f"WITH {PART} SELECT part, count(*) AS n_nodes FROM pn GROUP BY ALL")
def part_sizes(spark, sf):
    return pt.part_sizes(node_parts(spark, sf))


@query("unassigned_repair", f"WITH {PART}, m AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM pn WHERE node % 7 = 0) SELECT pn.node, CAST(coalesce(m.i % {PARTS}, part) AS INTEGER) AS part FROM pn LEFT JOIN m ON pn.node = m.node")
def unassigned_repair(spark, sf):
    holes = node_parts(spark, sf).withColumn("part", F.when(F.col("node") % 7 == 0, -1).otherwise(F.col("part")))
    return pt.repaired(holes)


@query("edge_owner", f"WITH {ENDS} SELECT eid, sp AS part FROM en")
def edge_owner(spark, sf):
    return pt.edge_owner(graph(spark, sf), node_parts(spark, sf))


@query("halo_nodes", f"WITH {HALO} SELECT * FROM ha")
def halo_nodes(spark, sf):
    return pt.halo(graph(spark, sf), node_parts(spark, sf))


@query("route_sizes", f"WITH {HALO} SELECT owner AS src_part, part AS dst_part, count(*) AS n FROM ha GROUP BY ALL")
def route_sizes(spark, sf):
    return pt.route_sizes(halo_nodes(spark, sf))


def _index(spark, sf):
    return pt.local_index(node_parts(spark, sf), halo_nodes(spark, sf))


@query("local_index", f"WITH {LOCAL} SELECT * FROM li")
def local_index(spark, sf):
    return _index(spark, sf)


@query("send_index", f"WITH {LOCAL} SELECT owner AS src_part, ha.part AS dst_part, ha.node, li.local FROM ha JOIN li ON li.part = ha.owner AND li.node = ha.node AND NOT li.is_halo")
def send_index(spark, sf):
    return pt.send_index(halo_nodes(spark, sf), _index(spark, sf))


BLOCK = f"{LOCAL}, bl AS (SELECT dp AS part, eid, a.local AS src_local, b.local AS dst_local, weight FROM en JOIN li a ON a.part = dp AND a.node = en.src JOIN li b ON b.part = dp AND b.node = en.dst)"


@query("block_edges", f"WITH {BLOCK} SELECT * FROM bl")
def block_edges(spark, sf):
    return pt.block_edges(graph(spark, sf), node_parts(spark, sf), _index(spark, sf))


@query("truncate_prefix", f"WITH {BLOCK} SELECT part, eid FROM bl WHERE src_local < 40 AND dst_local < 40")
def truncate_prefix(spark, sf):
    return pt.truncated(block_edges(spark, sf), 40).select("part", "eid")


@query("gcn_norm", f"""WITH {SNAP}, i AS (SELECT snap, dst, sum(weight) AS d FROM sn GROUP BY ALL), o AS (SELECT snap, src, sum(weight) AS d FROM sn GROUP BY ALL)
    SELECT eid, round(weight / (sqrt(greatest(i.d, 1e-12)) * sqrt(greatest(o.d, 1e-12))), 6) AS norm FROM sn JOIN i USING (snap, dst) JOIN o USING (snap, src)""")
def gcn_norm(spark, sf):
    return rounded(pt.gcn_norm(snapped(spark, sf), ["snap"]).select("eid", "norm"), "norm")


@query("gcn_norm_fallback", f"WITH {EV} SELECT eid, round(weight / greatest(sum(weight) OVER (PARTITION BY dst), 1.0), 6) AS norm FROM ev")
def gcn_norm_fallback(spark, sf):
    return rounded(pt.mean_norm(graph(spark, sf)).select("eid", "norm"), "norm")


@query("message_pass", f"""WITH {EV}, i AS (SELECT dst, sum(weight) AS d FROM ev GROUP BY ALL), o AS (SELECT src, sum(weight) AS d FROM ev GROUP BY ALL)
    SELECT dst AS node, round(sum(weight / (sqrt(greatest(i.d, 1e-12)) * sqrt(greatest(o.d, 1e-12))) * (src % 10)), 6) AS value FROM ev JOIN i USING (dst) JOIN o USING (src) GROUP BY ALL""")
def message_pass(spark, sf):
    normed = pt.gcn_norm(graph(spark, sf)).withColumn("value", F.col("src") % 10)
    return rounded(ms.propagate(normed), "value")


@query("message_pass_vectors", """SELECT l_partkey AS node, CAST(i AS INTEGER) AS i, round(sum(l_quantity * v), 4) AS x
    FROM lineitem JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) ON l_suppkey = vec_id GROUP BY ALL""")
def message_pass_vectors(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("norm"))
    f = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("feat"))
    return ms.propagate_entries(e, f).withColumn("x", F.round("x", 4))


@query("message_pass_whole_vectors", """SELECT l_partkey AS node, CAST(i - 1 AS INTEGER) AS i, round(sum(l_quantity * embedding[i]::DOUBLE), 4) AS x
    FROM lineitem JOIN embeddings ON l_suppkey = vec_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL""")
def message_pass_whole_vectors(spark, sf):
    return message_pass_vectors(spark, sf)


@query("edge_softmax", f"WITH {EV}, m AS (SELECT *, exp(weight - max(weight) OVER (PARTITION BY dst)) AS e FROM ev) SELECT eid, round(e / sum(e) OVER (PARTITION BY dst), 6) AS attention FROM m")
def edge_softmax(spark, sf):
    return rounded(ms.edge_softmax(graph(spark, sf), "weight").select("eid", "attention"), "attention")


@query("mean_pool", "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL")
def mean_pool(spark, sf):
    f = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("feat"))
    return rounded(ms.mean_pool(f, ["label"]), "mean")


@query("link_scores", f"""WITH {EV} SELECT eid, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) AS score
    FROM ev JOIN embeddings a ON ev.src = a.vec_id JOIN embeddings b ON ev.dst - 1000000 = b.vec_id""")
def link_scores(spark, sf):
    f = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = graph(spark, sf).join(f.toDF("src", "a"), "src").join(f.select((F.col("vec_id") + 1_000_000).alias("dst"), F.col("v").alias("b")), "dst")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("eid", F.round(dot, 6).alias("score"))


@query("cross_ratio", f"WITH {ENDS} SELECT round(avg(CASE WHEN sp <> dp THEN 1.0 ELSE 0.0 END), 6) AS ratio, count(*) AS n_edges FROM en")
def cross_ratio(spark, sf):
    return rounded(pt.cross_ratio(graph(spark, sf), node_parts(spark, sf)), "ratio")


def _chunked_nodes(spark, sf):
    return node_parts(spark, sf).withColumn("chunk", F.col("node") % 6)


@query("chunk_ends", f"WITH {PART}, c AS (SELECT 5 - node % 6 AS rank, count(*) AS n FROM pn GROUP BY ALL) SELECT rank, CAST(sum(n) OVER (ORDER BY rank) AS BIGINT) AS end FROM c")
def chunk_ends(spark, sf):
    return pt.chunk_ends(_chunked_nodes(spark, sf), pt.chunk_order("reverse", 6))


@query("chunk_reorder", f"WITH {PART}, c AS (SELECT node % 6 AS chunk, count(*) AS score FROM pn GROUP BY ALL) SELECT chunk, row_number() OVER (ORDER BY score DESC, chunk) - 1 AS rank FROM c")
def chunk_reorder(spark, sf):
    return pt.reordered(_chunked_nodes(spark, sf).groupBy("chunk").agg(F.count("*").alias("score")))


@query("node_permutation", f"WITH {PART} SELECT node, part, row_number() OVER (PARTITION BY part ORDER BY 5 - node % 6, node) - 1 AS place FROM pn")
def node_permutation(spark, sf):
    return pt.permuted(_chunked_nodes(spark, sf), pt.chunk_order("reverse", 6)).select("node", "part", "place")


@query("adjacency", f"WITH {EV} SELECT src AS node, row_number() OVER (PARTITION BY src ORDER BY dst, eid) - 1 AS i, dst AS nbr, eid FROM ev")
def adjacency(spark, sf):
    return pt.adjacency(graph(spark, sf))


@query("induced_subgraph", f"WITH {PART} SELECT eid, src, dst FROM ev WHERE src % 3 = 0 AND dst % 3 = 0")
def induced_subgraph(spark, sf):
    return pt.induced(graph(spark, sf), node_parts(spark, sf).where("node % 3 = 0")).select("eid", "src", "dst")


HOT = f"{EV}, dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ev UNION ALL SELECT dst FROM ev) GROUP BY ALL), hot AS (SELECT node, degree FROM dg ORDER BY degree DESC, node LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM dg))"


@query("hot_nodes", f"WITH {HOT} SELECT * FROM hot")
def hot_nodes(spark, sf):
    return pt.hot_nodes(graph(spark, sf))


def _sql_mixed(x: str, add: int = 11) -> str:
    return f"((({x}) % 2147483647) * 48271 + {add}) % 2147483647"


@query("hot_aware_cut", f"""WITH {HOT}, mk AS (SELECT eid, src, dst, CASE WHEN NOT EXISTS (SELECT 1 FROM hot WHERE node = src) THEN src WHEN NOT EXISTS (SELECT 1 FROM hot WHERE node = dst) THEN dst END AS key FROM ev),
    cu AS (SELECT eid, src, dst, CAST(coalesce({_sql_mixed('key')} % {PARTS}, ({_sql_mixed('src')} + {_sql_mixed('dst')}) % {PARTS}) AS INTEGER) AS part FROM mk),
    cp AS (SELECT node, count(*) AS c FROM (SELECT DISTINCT src AS node, part FROM cu UNION SELECT DISTINCT dst, part FROM cu) GROUP BY ALL)
    SELECT part, count(*) AS n, (SELECT round(avg(c), 6) FROM cp) AS copies FROM cu GROUP BY part""")
def hot_aware_cut(spark, sf):
    """Edges of each part of the vertex cut, and how many parts a node is in on average."""
    nodes, edges = pt.hot_aware(graph(spark, sf), PARTS)
    copies = nodes.groupBy("node").agg(F.count("*").alias("c")).agg(F.round(F.avg("c"), 6).alias("copies"))
    # the one row of the average
    return edges.groupBy("part").agg(F.count("*").alias("n")).crossJoin(F.broadcast(copies))


def _sql_towards(start: str, edges: str, rounds: int, room: str, turn: int) -> str:
    """Rounds of moves from the table ``start`` (slice, node, cluster, count) to the table
    a{rounds}, along edges (slice, node, nbr)."""
    out, at = [], start
    for r in range(rounds):
        out.append(f"""z{r} AS (SELECT slice, cluster, count(*) AS size FROM {at} GROUP BY ALL), t{r} AS (SELECT slice, {room} AS room FROM {at} GROUP BY slice),
            v{r} AS (SELECT e.slice, e.node, cluster, count(*) AS votes FROM {edges} e JOIN {at} a ON a.slice = e.slice AND a.node = e.nbr GROUP BY ALL),
            b{r} AS (SELECT slice, node, cluster AS goal FROM (SELECT *, row_number() OVER (PARTITION BY slice, node ORDER BY votes DESC, cluster) AS k FROM v{r}) WHERE k = 1),
            m{r} AS (SELECT a.slice, a.node, goal FROM {at} a JOIN b{r} USING (slice, node) WHERE cluster <> goal), w{r} AS (SELECT slice, goal, count(*) AS wanted FROM m{r} GROUP BY ALL),
            s{r} AS (SELECT w{r}.slice, goal, greatest(0.0, least(1.0, (room - coalesce(size, 0)) / wanted::DOUBLE)) AS share FROM w{r} LEFT JOIN z{r} ON z{r}.slice = w{r}.slice AND z{r}.cluster = goal JOIN t{r} ON t{r}.slice = w{r}.slice),
            a{r} AS (SELECT a.slice, a.node, coalesce(g.goal, a.cluster) AS cluster, a.count FROM {at} a LEFT JOIN (SELECT m{r}.slice, node, m{r}.goal FROM m{r} JOIN s{r} USING (slice, goal) WHERE {_sql_mixed('node', turn + r)} % 1048576 < share * 1048576) g ON g.slice = a.slice AND g.node = a.node)""")
        at = f"a{r}"
    return ", ".join(out)


@query("label_propagation_parts", f"""WITH {PART}, st0 AS (SELECT 0 AS slice, node, {_sql_mixed('node')} % {PARTS} AS cluster, {PARTS} AS count FROM pn),
    ne AS (SELECT DISTINCT 0 AS slice, src AS node, dst AS nbr FROM ev WHERE src <> dst UNION SELECT DISTINCT 0, dst, src FROM ev WHERE src <> dst),
    {_sql_towards('st0', 'ne', 3, f'floor(count(*) / {PARTS}.0::DOUBLE * 1.1)', 101)} SELECT node, CAST(cluster AS INTEGER) AS part FROM a2""")
def label_propagation_parts(spark, sf):
    return pt.label_propagation(graph(spark, sf), PARTS)


@query("second_level_chunks", f"""WITH {ENDS}, st0 AS (SELECT part AS slice, node, (row_number() OVER (PARTITION BY part ORDER BY node) - 1) % least(5, count(*) OVER (PARTITION BY part)) AS cluster, least(5, count(*) OVER (PARTITION BY part)) AS count FROM pn),
    ne AS (SELECT DISTINCT sp AS slice, src AS node, dst AS nbr FROM en WHERE sp = dp AND src <> dst UNION SELECT DISTINCT sp, dst, src FROM en WHERE sp = dp AND src <> dst),
    {_sql_towards('st0', 'ne', 2, 'floor(count(*) / min(count)::DOUBLE * 1.2)', 301)} SELECT node, slice AS part, CAST(cluster AS INTEGER) AS chunk FROM a1""")
def second_level_chunks(spark, sf):
    return pt.second_level(graph(spark, sf), node_parts(spark, sf), 5)


def _sql_slices() -> str:
    """Two tries: the second with the numbers of clusters that the first asks for."""
    out = [f"{SNAP}, sd AS (SELECT DISTINCT snap AS slice, node FROM (SELECT snap, src AS node FROM sn UNION ALL SELECT snap, dst FROM sn)), ne AS (SELECT DISTINCT snap AS slice, src AS node, dst AS nbr FROM sn WHERE src <> dst UNION SELECT DISTINCT snap, dst, src FROM sn WHERE src <> dst), c0 AS (SELECT DISTINCT slice, 3 AS count FROM sd)"]
    for k in range(2):
        rounds = _sql_towards(f"st{k}", "ne", 2, "floor(count(*) / min(count)::DOUBLE * 1.2)", 301)
        for name in "ztvbmwsa":
            for r in range(2):
                rounds = re.sub(rf"\b{name}{r}\b", f"{name}{r}_{k}", rounds)
        out.append(f"st{k} AS (SELECT slice, node, {_sql_mixed('node')} % count AS cluster, count FROM sd JOIN c{k} USING (slice)), {rounds}")
        out.append(f"c{k + 1} AS (SELECT sn.snap AS slice, CAST(CASE WHEN avg(CASE WHEN a.cluster <> b.cluster THEN 1.0::DOUBLE ELSE 0.0 END) > 0.2 THEN floor(min(a.count) * avg(CASE WHEN a.cluster <> b.cluster THEN 1.0::DOUBLE ELSE 0.0 END) / 0.2::DOUBLE) ELSE min(a.count) END AS BIGINT) AS count FROM sn JOIN a1_{k} a ON a.slice = sn.snap AND a.node = sn.src JOIN a1_{k} b ON b.slice = sn.snap AND b.node = sn.dst GROUP BY sn.snap)")
    return ", ".join(out)


@query("slice_clusters", f"WITH {_sql_slices()} SELECT slice, node, CAST(cluster AS INTEGER) AS cluster FROM a1_1")
def slice_clusters(spark, sf):
    return pt.slice_clusters(snapped(spark, sf).withColumnRenamed("snap", "slice"), 3, tries=2)


@query("snapshot_blocks", f"""WITH {LOCAL}, {SNAP[len(EV) + 2:]}, i AS (SELECT snap, dst, sum(weight) AS d FROM sn GROUP BY ALL), o AS (SELECT snap, src, sum(weight) AS d FROM sn GROUP BY ALL)
    SELECT CAST(dst % {PARTS} AS INTEGER) AS part, snap, eid, a.local AS src_local, b.local AS dst_local, round(weight / (sqrt(greatest(i.d, 1e-12)) * sqrt(greatest(o.d, 1e-12))), 6) AS norm
    FROM sn JOIN i USING (snap, dst) JOIN o USING (snap, src) JOIN li a ON a.part = dst % {PARTS} AND a.node = src JOIN li b ON b.part = dst % {PARTS} AND b.node = dst""")
def snapshot_blocks(spark, sf):
    return rounded(pt.snapshot_blocks(snapped(spark, sf), node_parts(spark, sf), _index(spark, sf)), "norm")


PLACES = f"{BLOCK}, pl AS (SELECT li.part, li.local, row_number() OVER (PARTITION BY li.part ORDER BY 5 - li.node % 6, li.node) - 1 AS place FROM li WHERE NOT is_halo)"


def _places(spark, sf):
    own = _index(spark, sf).where("not is_halo").select("part", "node", "local").withColumn("chunk", F.col("node") % 6)
    return pt.permuted(own, pt.chunk_order("reverse", 6)).select("part", "local", "place")


@query("permuted_blocks", f"WITH {PLACES} SELECT bl.part, eid, coalesce(a.place, src_local) AS src_local, coalesce(b.place, dst_local) AS dst_local, weight FROM bl LEFT JOIN pl a ON a.part = bl.part AND a.local = src_local LEFT JOIN pl b ON b.part = bl.part AND b.local = dst_local")
def permuted_blocks(spark, sf):
    return pt.permuted_edges(block_edges(spark, sf), _places(spark, sf)).select("part", "eid", "src_local", "dst_local", "weight")


@query("permuted_send_index", f"WITH {PLACES} SELECT owner AS src_part, ha.part AS dst_part, ha.node, pl.place AS local FROM ha JOIN li ON li.part = ha.owner AND li.node = ha.node AND NOT li.is_halo JOIN pl ON pl.part = li.part AND pl.local = li.local")
def permuted_send_index(spark, sf):
    return pt.permuted_send(send_index(spark, sf), _places(spark, sf))


@query("added_column", f"WITH {PART} SELECT pn.node, part, dg.degree FROM pn JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ev UNION ALL SELECT dst FROM ev) GROUP BY ALL) dg ON dg.node = pn.node")
def added_column(spark, sf):
    degree = graph(spark, sf).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return ev.with_values(node_parts(spark, sf), degree, "node", "degree")


@query("batch_caps", f"WITH {SPLIT} SELECT eid, split, batch FROM ba WHERE NOT (split = 'train' AND batch >= 3) AND NOT (split = 'val' AND batch >= 1)")
def batch_caps(spark, sf):
    """The feature of a run on the first batches of a split."""
    return ev.capped(split(spark, sf), {"train": 3, "val": 1}).select("eid", "split", "batch")


@query("node_histories", f"WITH {EV}, h AS (SELECT src AS node, ts, weight, row_number() OVER (PARTITION BY src ORDER BY ts, eid) - 1 AS n FROM ev) SELECT node, n // 16 AS block, CAST(n % 16 AS INTEGER) AS i, ts, weight AS value FROM h")
def node_histories(spark, sf):
    own = graph(spark, sf).select(F.col("src").alias("node"), "ts", F.col("eid").alias("ordinal"), "weight")
    return tp.node_histories(own, "weight", 16).select("node", "block", F.posexplode("history").alias("i", "h")).select("node", "block", "i", "h.ts", "h.value")


@query("partition_manifest", f"""WITH {HALO}, c AS (SELECT dp AS part, count(*) AS n_edges, count(*) FILTER (sp <> dp) AS n_cross FROM en GROUP BY ALL), n AS (SELECT part, count(*) AS n_nodes FROM pn GROUP BY ALL), h AS (SELECT part, count(*) AS n_halo FROM ha GROUP BY ALL)
    SELECT n.part, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_halo, 0) AS n_halo, coalesce(n_cross, 0) AS n_cross FROM n LEFT JOIN c ON c.part = n.part LEFT JOIN h ON h.part = n.part""")
def partition_manifest(spark, sf):
    return pt.manifest(graph(spark, sf), node_parts(spark, sf))


@query("loss_scale", f"WITH {PART} SELECT part, round(count(*) / (SELECT count(*) FROM pn)::DOUBLE, 6) AS scale FROM pn GROUP BY ALL")
def loss_scale(spark, sf):
    return rounded(pt.loss_scales(node_parts(spark, sf)), "scale")


@query("local_mask", f"WITH {HALO} SELECT DISTINCT pn.node, pn.part = 2 AS is_local FROM pn")
def local_mask(spark, sf):
    parts = node_parts(spark, sf)
    return pt.is_local(parts.select("node"), parts, 2)


@query("owner_packing", f"WITH {PART} SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS position FROM pn WHERE node IN (SELECT dst FROM ev)")
def owner_packing(spark, sf):
    return pt.packed_by_owner(graph(spark, sf).select(F.col("dst").alias("node")), node_parts(spark, sf))


@query("route_reverse", f"WITH {HALO}, g AS (SELECT dp AS part, src AS node, sum(weight) AS value FROM en GROUP BY ALL) SELECT owner AS part, g.node, round(sum(value), 6) AS value FROM g JOIN ha ON ha.part = g.part AND ha.node = g.node GROUP BY ALL")
def route_reverse(spark, sf):
    """What parts gathered for halo nodes, summed at their owners."""
    g, parts = graph(spark, sf), node_parts(spark, sf)
    held = g.join(parts.select(F.col("node").alias("dst"), "part"), "dst").groupBy("part", F.col("src").alias("node")).agg(F.sum("weight").alias("value"))
    return rounded(pt.scattered_back(held, pt.halo(g, parts)), "value")


@query("feature_summary", f"""WITH {ENDS}, f AS (SELECT src AS node, sum(weight) AS a, count(*)::DOUBLE AS b FROM ev GROUP BY ALL), s AS (SELECT dp AS part, avg(CASE WHEN sp = dp THEN 1.0 ELSE 0.0 END) AS local_share FROM en GROUP BY ALL),
    o AS (SELECT part, avg(a) AS first, avg(b) AS second, count(*) / (SELECT count(*) FROM pn)::DOUBLE AS node_share FROM pn LEFT JOIN f ON f.node = pn.node GROUP BY ALL)
    SELECT o.part, round(first, 6) AS first, round(second, 6) AS second, round(local_share, 6) AS local_share, round(node_share, 6) AS node_share FROM o LEFT JOIN s ON s.part = o.part""")
def feature_summary(spark, sf):
    g = graph(spark, sf)
    feats = g.groupBy(F.col("src").alias("node")).agg(F.array(F.sum("weight"), F.count("*").cast("double")).alias("feat"))
    return rounded(ms.feature_summary(g, node_parts(spark, sf), feats), "first", "second", "local_share", "node_share")


@query("memory_estimate", f"WITH {PART} SELECT (SELECT count(*) FROM pn) * 16 * 4 * 5 + (SELECT count(*) FROM ev) * 2 * 4 AS bytes")
def memory_estimate(spark, sf):
    g = graph(spark, sf)
    sizes = g.agg(F.count("*").alias("e"), F.lit(1).alias("k")).join(F.broadcast(node_parts(spark, sf).agg(F.count("*").alias("v"), F.lit(1).alias("k"))), "k")
    return sizes.select(sp.memory_estimate(F.col("v"), F.col("e"), 16).alias("bytes"))


# State

def _train(spark, sf):
    return split(spark, sf).where("split = 'train'")


@query("mailbox_last", f"""WITH {MAIL}, s AS (SELECT node, slot, max_by({{'eid': last.eid, 'ts': last.ts, 'peer': last.peer}}, batch * 2 + side) AS m FROM wr GROUP BY ALL)
    SELECT node, slot, m.eid AS eid, m.ts AS ts, m.peer AS peer FROM s""")
def mailbox_last(spark, sf):
    return st.mailbox(_train(spark, sf), SLOTS)


@query("mailbox_ring_pos", f"WITH {MAIL} SELECT node, count(*) % {SLOTS} AS pos FROM ma GROUP BY ALL")
def mailbox_ring_pos(spark, sf):
    return st.ring_position(_train(spark, sf), SLOTS)


@query("mailbox_messages", f"""WITH {MAIL}, s AS (SELECT node, slot, max_by({{'eid': last.eid, 'peer': last.peer}}, batch * 2 + side) AS m FROM wr GROUP BY ALL)
    SELECT node, slot, (node % 5)::DOUBLE AS own, (m.peer % 5)::DOUBLE AS peer_mem, CAST(4 AS INTEGER) AS width FROM s""")
def mailbox_messages(spark, sf):
    memory = node_parts(spark, sf).select("node", F.array((F.col("node") % 5).cast("double")).alias("memory"))
    feats = graph(spark, sf).select("eid", F.array("weight").alias("feat"))
    full = st.messages(st.mailbox(_train(spark, sf), SLOTS), memory, feats, 2)
    return full.select("node", "slot", F.col("mail")[0].alias("own"), F.col("mail")[1].alias("peer_mem"), F.size("mail").alias("width"))


@query("memory_last", f"WITH {EV} SELECT src AS node, arg_max(weight, rn) AS value, max(ts) AS ts FROM ev GROUP BY ALL")
def memory_last(spark, sf):
    return st.memory_last(graph(spark, sf).select(F.col("src").alias("node"), F.col("weight").alias("value"), "ts", "eid"))


@query("memory_touched", f"WITH {MAIL}, l AS (SELECT batch, max(ts) AS t FROM tr GROUP BY ALL) SELECT node, max(t) AS memory_ts FROM ma JOIN l USING (batch) GROUP BY ALL")
def memory_touched(spark, sf):
    return st.touched(_train(spark, sf))


NEWER = f"{EV}, a AS (SELECT src AS node, max(ts) AS ts, count(*) AS n FROM ev WHERE eid % 2 = 0 GROUP BY ALL), b AS (SELECT src AS node, max(ts) AS ts, count(*) AS n FROM ev WHERE eid % 2 = 1 AND src % 3 <> 0 GROUP BY ALL)"


@query("mail_merge_newer", f"WITH {NEWER} SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL OR b.ts > a.ts THEN b.ts ELSE a.ts END AS ts, CASE WHEN a.node IS NULL OR b.ts > a.ts THEN b.n ELSE a.n END AS n FROM a FULL JOIN b ON a.node = b.node")
def mail_merge_newer(spark, sf):
    each = lambda g: g.groupBy(F.col("src").alias("node")).agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    g = graph(spark, sf)
    return st.newer(each(g.where("eid % 2 = 0")), each(g.where("eid % 2 = 1 and src % 3 != 0")))


@query("cosine_changed", """SELECT a.vec_id AS node, b.vec_id IS NULL OR 1.0 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.9 AS changed
    FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND b.vec_id % 5 <> 0""")
def cosine_changed(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("memory"))
    cached = v.where("node % 5 != 0").select((F.col("node") - 1).alias("node"), "memory")
    return st.changed(v, cached, 0.1).select("node", "changed")


@query("state_pad", f"WITH {PART}, s AS (SELECT src AS node, max(weight) AS w FROM ev GROUP BY ALL) SELECT pn.node, coalesce(w, 0.0) AS state FROM pn LEFT JOIN s ON pn.node = s.node")
def state_pad(spark, sf):
    state = graph(spark, sf).groupBy(F.col("src").alias("node")).agg(F.array(F.max("weight")).alias("state"))
    return st.padded(node_parts(spark, sf).select("node"), state, 1).select("node", F.col("state")[0].alias("state"))


@query("state_mix", f"WITH {SNAP}, c AS (SELECT src AS node, max(weight) AS w FROM sn WHERE snap = 5 GROUP BY ALL), p AS (SELECT src AS node, max(weight) AS w FROM sn WHERE snap < 5 GROUP BY ALL) SELECT coalesce(c.node, p.node) AS node, coalesce(c.w, p.w) AS state FROM c FULL JOIN p ON c.node = p.node")
def state_mix(spark, sf):
    g = snapped(spark, sf)
    each = lambda x: x.groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("state"))
    return st.mixed(each(g.where("snap = 5")), each(g.where("snap < 5")))


@query("reuse_table", f"WITH {SNAP}, a AS (SELECT DISTINCT src AS node, snap AS slice FROM sn) SELECT *, lead(slice) OVER (PARTITION BY node ORDER BY slice) AS next_slice, lead(slice) OVER (PARTITION BY node ORDER BY slice) - slice AS gap FROM a")
def reuse_table(spark, sf):
    return st.reuse(snapped(spark, sf).select(F.col("src").alias("node"), F.col("snap").alias("slice")))


@query("most_used", f"WITH {EV} SELECT dst AS node, count(*) AS uses FROM ev GROUP BY ALL ORDER BY uses DESC, node LIMIT 20")
def most_used(spark, sf):
    return st.most_used(graph(spark, sf).select(F.col("dst").alias("node")), 20)


# Negatives and chunks

POOL = f"{EV}, po AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT dst AS node FROM ev)), np AS (SELECT count(*) AS n FROM po)"
NEG = f"""{POOL}, dr AS (SELECT eid, src, dst, ((eid * 48271 + 7) % 2147483647) % n AS i, n FROM ev, np), mv AS (SELECT dr.eid, dr.src, dr.dst, CASE WHEN po.node = dr.dst THEN (dr.i + 1) % n ELSE dr.i END AS i FROM dr JOIN po ON po.i = dr.i),
    ne AS (SELECT eid, src, dst, node AS neg FROM mv JOIN po ON po.i = mv.i)"""


@query("dst_pool", f"WITH {POOL} SELECT i, node FROM po")
def dst_pool(spark, sf):
    return sp.pool(graph(spark, sf))


@query("negatives", f"WITH {NEG} SELECT * FROM ne")
def negatives(spark, sf):
    g = graph(spark, sf)
    return sp.negatives(g, sp.pool(g))


@query("negatives_excluded", f"WITH {NEG} SELECT * FROM ne WHERE src <> neg AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.src = ne.src AND ev.dst = ne.neg)")
def negatives_excluded(spark, sf):
    g = graph(spark, sf)
    return sp.without_positives(negatives(spark, sf), g)


CHUNK = f"{SNAP}, ch AS (SELECT sn.*, snap AS slice, src % 3 AS src_cluster, dst % 3 AS dst_cluster, CASE WHEN src % 3 = dst % 3 THEN src % 3 ELSE -1 END AS cluster FROM sn), ct AS (SELECT *, row_number() OVER (ORDER BY slice, cluster) - 1 AS chunk_id FROM (SELECT slice, cluster, count(*) AS n_edges, min(ts) AS t_start, max(ts) AS t_end FROM ch GROUP BY ALL))"


def _chunks(spark, sf):
    clusters = node_parts(spark, sf).select("node", (F.col("node") % 3).alias("cluster"))
    return sp.chunks(snapped(spark, sf), F.col("snap"), clusters)


@query("chunk_expand", f"WITH {CHUNK} SELECT * FROM ct")
def chunk_expand(spark, sf):
    return sp.chunk_table(_chunks(spark, sf))


@query("chunk_cross_edges", f"WITH {CHUNK} SELECT slice, src_cluster AS from_cluster, dst_cluster AS to_cluster, count(*) AS n FROM ch WHERE src_cluster <> dst_cluster GROUP BY ALL")
def chunk_cross_edges(spark, sf):
    return sp.cross_edges(_chunks(spark, sf))


@query("chunk_temporal_deps", f"WITH {CHUNK} SELECT a.chunk_id, b.chunk_id AS dep, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.slice DESC) AS steps_back, round(pow(0.9, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.slice DESC)), 6) AS weight FROM ct a JOIN ct b ON a.cluster = b.cluster AND b.slice < a.slice")
def chunk_temporal_deps(spark, sf):
    return rounded(sp.temporal_deps(chunk_expand(spark, sf), None), "weight")


@query("chunk_graph_deps", f"WITH {CHUNK} SELECT DISTINCT slice, src_cluster AS cluster, dst_cluster AS dep_cluster FROM ch WHERE src_cluster <> dst_cluster UNION SELECT DISTINCT slice, dst_cluster, src_cluster FROM ch WHERE src_cluster <> dst_cluster")
def chunk_graph_deps(spark, sf):
    return sp.graph_deps(_chunks(spark, sf))


@query("chunk_remote_nodes", f"WITH {CHUNK} SELECT slice, cluster, node, home, count(*) AS n FROM (SELECT slice, src_cluster AS cluster, dst AS node, dst_cluster AS home FROM ch WHERE src_cluster <> dst_cluster UNION ALL SELECT slice, dst_cluster, src, src_cluster FROM ch WHERE src_cluster <> dst_cluster) GROUP BY ALL")
def chunk_remote_nodes(spark, sf):
    return sp.remote_nodes(_chunks(spark, sf))


@query("chunk_prepared", f"""WITH {CHUNK}, ii AS (SELECT slice, cluster, eid, src, dst FROM ch WHERE src_cluster = dst_cluster), ln AS (SELECT slice, cluster, node, row_number() OVER (PARTITION BY slice, cluster ORDER BY node) - 1 AS local FROM (SELECT slice, cluster, src AS node FROM ii UNION SELECT slice, cluster, dst FROM ii)),
    {NEG[len(EV) + 2:]} SELECT ii.slice, ii.cluster, ii.eid, a.local AS src_local, b.local AS dst_local, c.local AS neg_local FROM ii JOIN ne USING (eid)
    JOIN ln a ON a.slice = ii.slice AND a.cluster = ii.cluster AND a.node = ii.src JOIN ln b ON b.slice = ii.slice AND b.cluster = ii.cluster AND b.node = ii.dst LEFT JOIN ln c ON c.slice = ii.slice AND c.cluster = ii.cluster AND c.node = neg""")
def chunk_prepared(spark, sf):
    """Edges inside chunks by local node numbers, negatives where they lie in the chunk."""
    return sp.prepared(_chunks(spark, sf), negatives(spark, sf))


@query("feature_lookup", f"WITH {PART} SELECT node, coalesce(embedding[1]::DOUBLE, 0.0) AS f0, coalesce(embedding[64]::DOUBLE, 0.0) AS f63 FROM pn LEFT JOIN embeddings ON vec_id = node")
def feature_lookup(spark, sf):
    feats = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("memory"))
    return st.gathered(node_parts(spark, sf).select("node"), feats, 64).select("node", F.col("memory")[0].alias("f0"), F.col("memory")[63].alias("f63"))


@query("chunk_completed", f"""WITH {CHUNK}, nd AS (SELECT slice, src_cluster AS cluster, src AS node, FALSE AS is_remote FROM ch UNION SELECT slice, dst_cluster, dst, FALSE FROM ch UNION SELECT slice, src_cluster, dst, src_cluster <> dst_cluster FROM ch UNION SELECT slice, dst_cluster, src, src_cluster <> dst_cluster FROM ch)
    SELECT slice, cluster, node, is_remote, coalesce(embedding[1]::DOUBLE, 0.0) AS f0 FROM nd LEFT JOIN embeddings ON vec_id = node""")
def chunk_completed(spark, sf):
    """The nodes that each chunk needs, with features where there are any."""
    feats = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("feat"))
    return sp.completed(sp.chunk_nodes(_chunks(spark, sf)), feats, 64).select("slice", "cluster", "node", "is_remote", F.col("feat")[0].alias("f0"))


# Metrics

@query("auc_score", f"WITH {SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY ALL), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g) SELECT round(sum(p * (nb + n / 2.0))::DOUBLE / (sum(p)::DOUBLE * sum(n)::DOUBLE), 6) AS auc, round(sum(p * nb)::DOUBLE / (sum(p)::DOUBLE * sum(n)::DOUBLE), 6) AS auc_strict FROM c")
def auc_score(spark, sf):
    return rounded(mt.auc(scored(spark, sf)), "auc", "auc_strict")


@query("pairwise_win_rate", f"WITH {SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY ALL), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g), r AS (SELECT round(sum(p * nb)::DOUBLE / (sum(p)::DOUBLE * sum(n)::DOUBLE), 6) AS v FROM c) SELECT v AS pairwise_win_rate, v AS mrr FROM r")
def pairwise_win_rate(spark, sf):
    return rounded(mt.pairwise_win_rate(scored(spark, sf)), "pairwise_win_rate", "mrr")


@query("ap_score", f"WITH {SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) AS k FROM sc GROUP BY ALL), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(k) OVER (ORDER BY score DESC) AS seen FROM g) SELECT round(sum(p::DOUBLE * tp::DOUBLE / seen::DOUBLE) / sum(p)::DOUBLE, 6) AS ap FROM c")
def ap_score(spark, sf):
    return rounded(mt.average_precision(scored(spark, sf)), "ap")


@query("pseudo_ap", f"WITH {SCORED} SELECT round(least(greatest((avg(1 / (1 + exp(-score))) FILTER (label = 1) - avg(1 / (1 + exp(-score))) FILTER (label = 0)) / 2 + 0.5, 0), 1), 6) AS pseudo_ap FROM sc")
def pseudo_ap(spark, sf):
    return rounded(mt.pseudo_ap(scored(spark, sf)), "pseudo_ap")


@query("bce_loss", f"WITH {SCORED} SELECT round(avg(greatest(score, 0.0) - score * label + ln(1 + exp(-abs(score)))), 6) AS bce FROM sc")
def bce_loss(spark, sf):
    return rounded(mt.bce(scored(spark, sf)), "bce")


def _pairs(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_quantity") * 1000).alias("pred"), F.col("l_extendedprice").alias("label"))


@query("regression_metrics", "WITH p AS (SELECT l_quantity * 1000 AS pred, l_extendedprice AS label FROM lineitem) SELECT round(avg(abs(pred - label)), 4) AS mae, round(sqrt(avg((pred - label) * (pred - label))), 4) AS rmse, round(avg(abs(pred - label)) / abs(avg(label)), 6) AS nmae FROM p")
def regression_metrics(spark, sf):
    m = mt.regression(_pairs(spark, sf))
    return m.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("nmae", 6).alias("nmae"))


@query("mse_loss", "SELECT round(avg((l_quantity - l_tax) * (l_quantity - l_tax)), 5) AS mse FROM lineitem")
def mse_loss(spark, sf):
    return mt.mse(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("pred"), F.col("l_tax").alias("label"))).select(F.round("mse", 5).alias("mse"))


def _logits(spark, sf):
    return table(spark, sf, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("logits"), "label")


@query("classification_metrics", "WITH l AS (SELECT embedding[1:10]::DOUBLE[] AS x, label FROM embeddings) SELECT round(avg(CASE WHEN list_position(x, list_max(x)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l")
def classification_metrics(spark, sf):
    return rounded(mt.accuracy(_logits(spark, sf)), "accuracy")


@query("ce_loss", "WITH l AS (SELECT embedding[1:10]::DOUBLE[] AS x, label FROM embeddings) SELECT round(avg(ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[label + 1]), 6) AS ce FROM l")
def ce_loss(spark, sf):
    return rounded(mt.cross_entropy(_logits(spark, sf)), "ce")


@query("epoch_summary", f"WITH {SPLIT}, s AS (SELECT split, batch, avg(weight) AS loss, (max(ts) - min(ts))::DOUBLE AS elapsed FROM ba GROUP BY ALL) SELECT round(avg(loss), 6) AS loss, max(elapsed) AS elapsed FROM s")
def epoch_summary(spark, sf):
    steps = split(spark, sf).groupBy("split", "batch").agg(F.avg("weight").alias("loss"), (F.max("ts") - F.min("ts")).cast("double").alias("elapsed"))
    return rounded(mt.epoch_summary(steps), "loss")


# Event-time windows, folds and streams

def _at(spark, sf):
    return graph(spark, sf, F.col("ts").cast("timestamp").alias("at"))


@query("tumbling_windows", f"WITH {EV} SELECT CAST(floor(ts / 86400000000) * 86400000000 AS BIGINT) AS start, src, count(*) AS n, round(sum(weight), 6) AS weight FROM ev GROUP BY ALL")
def tumbling_windows(spark, sf):
    w = sn.time_windows(_at(spark, sf), F.col("at"), "1 day")
    return rounded(w.select(F.unix_micros("w.start").alias("start"), "src", "n", "weight"), "weight")


@query("session_windows", f"WITH {EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY src ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS cut FROM ev), s AS (SELECT *, sum(cut) OVER (PARTITION BY src ORDER BY ts) AS k FROM g) SELECT src, min(ts) AS start, count(*) AS n, round(sum(weight), 6) AS weight FROM s GROUP BY src, k")
def session_windows(spark, sf):
    from chronoloom.streaming.state import sessions

    s = sessions(_at(spark, sf), "6 hours")
    return rounded(s.select("src", F.unix_micros("w.start").alias("start"), "n", "weight"), "weight")


# Files, prepared tables and sessions

def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("read_edges", "SELECT k.kind, l_suppkey AS src, l_partkey AS dst, CAST(l_orderkey AS DOUBLE) AS ts, CASE WHEN k.kind = 'lines' THEN 1.0 ELSE l_quantity END AS weight FROM lineitem, (SELECT unnest(['csv', 'lines', 'parquet']) AS kind) k")
def read_edges(spark, sf):
    """One graph written as a headed table, as lines and as Parquet, and read back by kind."""
    g = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("ts"), F.col("l_quantity").alias("weight"))
    root = _folder(spark)
    g.write.option("header", True).csv(f"{root}/csv")
    artifacts.write_edge_lines(g, f"{root}/lines")
    g.write.parquet(f"{root}/parquet")
    each = [src.read_edges(spark, f"{root}/{k}", k).withColumn("kind", F.lit(k)) for k in ("csv", "lines", "parquet")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("edge_file_features", "SELECT event_id AS eid, user_id AS src, CAST(length(props) AS DOUBLE) AS f0, value AS f1 FROM events")
def edge_file_features(spark, sf):
    """A headed table with a table of edge features beside it."""
    e, root = table(spark, sf, "events"), _folder(spark)
    e.select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), (F.col("user_id") + 1).alias("dst"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time")).write.option("header", True).csv(f"{root}/edges")
    e.select(F.col("event_id").alias("eid"), F.length("props").alias("n"), "value").write.option("header", True).csv(f"{root}/features")
    return src.read_edges(spark, f"{root}/edges", "csv", features=f"{root}/features").select("eid", "src", F.col("feat")[0].alias("f0"), F.col("feat")[1].alias("f1"))


@query("preset_dataset", f"""WITH {EV}, t0 AS (SELECT ts FROM (SELECT DISTINCT ts FROM ev) ORDER BY ts LIMIT 1 OFFSET 1), b AS (SELECT (SELECT ts FROM t0) AS s, greatest((SELECT ts FROM t0) + 1, max(ts)) AS e FROM ev), w AS (SELECT s, greatest(1.0, (e - s)::DOUBLE / 100) AS itv FROM b),
    h AS (SELECT i, eid, weight FROM ev, w, (SELECT unnest(range(90)) AS i) WHERE ts >= s + i * itv AND ts < s + (i + 11) * itv)
    SELECT dense_rank() OVER (ORDER BY i) - 1 AS snap, count(*) AS n FROM h GROUP BY i""")
def preset_dataset(spark, sf):
    """Sliding windows by a preset over an edge list in a file."""
    path = f"{_folder(spark)}/edges"
    artifacts.write_edge_lines(graph(spark, sf), path)
    return load_dataset(spark, path, "soc-bitcoin", 4).edges.groupBy("snap").agg(F.count("*").alias("n"))


def _session(spark, sf, mode: str) -> Session:
    s = Session.from_config(spark, {"mode": mode, "parts": PARTS, "snaps": SNAPS, "batch_size": BATCH}, graph(spark, sf), _folder(spark))
    s.prepare_data()
    return s.build_runtime()


IDS = "ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev))"


@query("session_events", f"WITH {SPLIT}, {IDS} SELECT eid, a.id AS src, b.id AS dst, split, batch, CAST(a.id % {PARTS} AS INTEGER) AS part FROM ba JOIN ids a ON a.node = src JOIN ids b ON b.node = dst")
def session_events(spark, sf):
    """Prepared events as a session reads them back."""
    return _session(spark, sf, "ctdg").tables["events"].select("eid", "src", "dst", "split", "batch", F.col("part").cast("int").alias("part"))


@query("session_boundaries", f"WITH {SPLIT} SELECT split, batch, min(eid) AS first, max(eid) AS last, min(ts) AS t_start, max(ts) AS t_end, count(*) AS n FROM ba GROUP BY ALL")
def session_boundaries(spark, sf):
    return _session(spark, sf, "ctdg").tables["boundaries"]


@query("session_blocks", f"""WITH {SNAP}, {IDS}, g AS (SELECT snap, eid, a.id AS src, b.id AS dst, weight FROM sn JOIN ids a ON a.node = src JOIN ids b ON b.node = dst), i AS (SELECT snap, dst, sum(weight) AS d FROM g GROUP BY ALL), o AS (SELECT snap, src, sum(weight) AS d FROM g GROUP BY ALL)
    SELECT CAST(dst % {PARTS} AS INTEGER) AS part, snap, count(*) AS n, round(sum(weight / (sqrt(greatest(i.d, 1e-12)) * sqrt(greatest(o.d, 1e-12)))), 5) AS norm FROM g JOIN i USING (snap, dst) JOIN o USING (snap, src) GROUP BY ALL""")
def session_blocks(spark, sf):
    blocks = _session(spark, sf, "dtdg").tables["blocks"]
    return blocks.groupBy("part", "snap").agg(F.count("*").alias("n"), F.round(F.sum("norm"), 5).alias("norm"))


@query("session_chunks", f"WITH {SNAP}, {IDS}, g AS (SELECT snap AS slice, ts, CASE WHEN a.id % {PARTS} = b.id % {PARTS} THEN a.id % {PARTS} ELSE -1 END AS cluster FROM sn JOIN ids a ON a.node = src JOIN ids b ON b.node = dst) SELECT slice, CAST(cluster AS INTEGER) AS cluster, count(*) AS n_edges, min(ts) AS t_start, max(ts) AS t_end, row_number() OVER (ORDER BY slice, cluster) - 1 AS chunk_id FROM g GROUP BY slice, cluster")
def session_chunks(spark, sf):
    return _session(spark, sf, "chunk").tables["chunks"].select("slice", "cluster", "n_edges", "t_start", "t_end", "chunk_id")


SCORES = f"""{SPLIT}, {IDS}, g AS (SELECT eid, a.id AS src, b.id AS dst, ts, split FROM sp JOIN ids a ON a.node = src JOIN ids b ON b.node = dst), po AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT dst AS node FROM g)), np AS (SELECT count(*) AS n FROM po),
    dr AS (SELECT eid, src, dst, ts, ((eid * 48271 + 7) % 2147483647) % n AS i, n FROM g, np WHERE split = 'val'), mv AS (SELECT dr.*, CASE WHEN po.node = dr.dst THEN (dr.i + 1) % n ELSE dr.i END AS j FROM dr JOIN po ON po.i = dr.i),
    pa AS (SELECT eid, src, dst, ts, 1 AS label FROM g WHERE split = 'val' UNION ALL SELECT eid, src, node, ts, 0 FROM mv JOIN po ON po.i = mv.j),
    me AS (SELECT pa.eid, pa.label, max_by(g.eid, {{'ts': g.ts, 'eid': g.eid}}) AS seen FROM pa LEFT JOIN g ON g.src = pa.src AND g.dst = pa.dst AND g.ts < pa.ts GROUP BY ALL)"""


@query("session_scores", f"WITH {SCORES} SELECT eid, label, round(CASE WHEN seen IS NULL THEN -1.0 ELSE 1.0 / (1 + eid - seen) END, 6) AS score FROM me")
def session_scores(spark, sf):
    """Validation events and a negative for each, scored by how lately the pair met."""
    return rounded(_session(spark, sf, "ctdg").score("val").select("eid", "label", "score"), "score")


@query("session_task")
def session_task(spark, sf):
    """Two epochs of training with the validation split after each."""
    s = _session(spark, sf, "ctdg")
    s.config["epochs"] = 2
    return s.run_task()


@query("checkpoint_state", f"""WITH {SPLIT}, {IDS}, m AS (SELECT CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS o, batch, eid, ts, a.id AS src, b.id AS dst FROM ba JOIN ids a ON a.node = src JOIN ids b ON b.node = dst),
    s AS (SELECT o, batch, eid, ts, src AS node, dst AS peer, 0 AS side FROM m UNION ALL SELECT o, batch, eid, ts, dst, src, 1 FROM m),
    c AS (SELECT node, o, batch, side, max({{'ts': ts, 'eid': eid, 'peer': peer}}) AS last FROM s GROUP BY ALL)
    SELECT node, max_by(last.eid, o * 100000000 + batch * 2 + side) AS eid, max_by(last.peer, o * 100000000 + batch * 2 + side) AS peer FROM c GROUP BY node""")
def checkpoint_state(spark, sf):
    """The mailbox of a saved and loaded session."""
    s, path = _session(spark, sf, "ctdg"), _folder(spark)
    s.save_checkpoint(path)
    return s.load_checkpoint(path)["mailbox"].select("node", "eid", "peer")


@query("mailbox_streamed", ORACLES["mailbox_last"].replace(", m.ts AS ts, m.peer AS peer", ", m.ts AS ts"))
def mailbox_streamed(spark, sf):
    """The mailbox as a stream builds it, its last state per slot."""
    from chronoloom.streaming.state import mailbox_stream

    root = _folder(spark)
    events = _train(spark, sf).select("batch", "eid", "src", "dst", "ts")
    events.write.parquet(f"{root}/in")
    updates = mailbox_stream(spark.readStream.schema(events.schema).parquet(f"{root}/in"), SLOTS)
    q = updates.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/n={n}")).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("node", "slot").agg(F.max_by(F.struct("eid", "ts"), "n").alias("m")).select("node", "slot", "m.*")


STRETCH = 43_200_000_000  # half a day


@query("mailbox_in_time", f"""WITH {EV}, ma AS (SELECT ts // {STRETCH} AS batch, eid, ts, src AS node, dst AS peer, 0 AS side FROM ev UNION ALL SELECT ts // {STRETCH}, eid, ts, dst, src, 1 FROM ev),
    ca AS (SELECT node, batch, side, count(*) AS n, max({{'ts': ts, 'eid': eid, 'peer': peer}}) AS last FROM ma GROUP BY ALL),
    wr AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY node ORDER BY batch, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) % {SLOTS} AS slot FROM ca)
    SELECT node, slot, m.eid AS eid, m.peer AS peer FROM (SELECT node, slot, max_by(last, batch * 2 + side) AS m FROM wr GROUP BY ALL)""")
def mailbox_in_time(spark, sf):
    """The mailbox as timers in keyed state build it; a later event of no node closes the
    last stretch."""
    from chronoloom.streaming import mailbox as mb

    root = _folder(spark)
    events = graph(spark, sf).select("eid", "src", "dst", "ts")
    end = events.agg(F.lit(-1).cast("long").alias("eid"), F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), (F.max("ts") + 3 * STRETCH).alias("ts"))
    events.unionByName(end).write.parquet(f"{root}/in")
    rings = mb.mailbox_in_time(spark.readStream.schema(events.schema).parquet(f"{root}/in"), SLOTS, STRETCH, "1 hour")
    with mb.keyed_state(spark):
        q = rings.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/out").where("node >= 0")
    return rows.groupBy("node", "slot").agg(F.max_by(F.struct("eid", "peer"), "touched").alias("m")).select("node", "slot", "m.*")


# Models: learned weights are stood in for by fixed ones

def fixed_weights(seed: int, *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.5, shape)


def _sql_list(values) -> str:
    return "[" + ",".join(_sql_list(v) if np.ndim(v) else f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _sql_linear(vector: str, matrix: np.ndarray, bias: np.ndarray | None = None) -> str:
    """vector @ matrix + bias of a list."""
    columns = matrix.T if bias is None else np.c_[matrix.T, bias]
    return f"list_transform({_sql_list(columns)}, lambda c: list_inner_product({vector if bias is None else f'list_append({vector}, 1.0::DOUBLE)'}, c))"


def _sql_each(n: int, term: str) -> str:
    """A list of a term for i from 1 to n."""
    return f"list_transform(range(1, {n + 1}), lambda i: {term})"


def _sigm(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _tanh(x: str) -> str:
    return f"(2 / (1 + exp(-2 * ({x}))) - 1)"


def _sql_fold(levels: list[dict[str, str]], width: int) -> str:
    """A recursive table st (node, snap, rn, h) over x (node, snap, rn, x): each level adds
    columns to x and h, and the last one has the new state as ``new``."""

    def step(rows: str) -> str:
        for level in levels:
            rows = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in level.items())} FROM ({rows})"
        return f"SELECT node, snap, rn, new AS h FROM ({rows})"

    first = step(f"SELECT node, snap, rn, x, {_sql_list([0] * width)} AS h FROM x WHERE rn = 1")
    return f"st AS ({first} UNION ALL {step('SELECT x.node, x.snap, x.rn, x.x, st.h FROM st JOIN x ON x.node = st.node AND x.rn = st.rn + 1')})"


def _sql_gru(x: str, h: str, w: dict, d: int, name: str) -> list[dict[str, str]]:
    a, b = f"a_{name}", f"b_{name}"
    z, r = _sigm(f"{a}[{d} + i] + {b}[{d} + i]"), _sigm(f"{a}[i] + {b}[i]")
    return [{a: _sql_linear(x, w["wi"], w["bi"]), b: _sql_linear(h, w["wh"], w["bh"])}, {name: _sql_each(d, f"(1 - {z}) * {_tanh(f'{a}[{2 * d} + i] + {r} * {b}[{2 * d} + i]')} + {z} * ({h})[i]")}]


def _sql_lstm(x: str, h: str, c: str, w: dict, d: int, name: str) -> list[dict[str, str]]:
    """The new hidden state as h_name, the new cell as c_name."""
    g = lambda k: f"a_{name}[{k * d} + i] + b_{name}[{k * d} + i]"
    return [
        {f"a_{name}": _sql_linear(x, w["wi"], w["bi"]), f"b_{name}": _sql_linear(h, w["wh"], w["bh"])},
        {f"c_{name}": _sql_each(d, f"{_sigm(g(1))} * ({c})[i] + {_sigm(g(0))} * {_tanh(g(2))}")},
        {f"h_{name}": _sql_each(d, f"{_sigm(g(3))} * {_tanh(f'c_{name}[i]')}")},
    ]


def _entries(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """A row for each entry of a vector."""
    return df.select(*keys, F.posexplode(column).alias("i", "x")).withColumn("x", F.round("x", 5))


def _sql_entries(rows: str, column: str, keys: str, n: int) -> str:
    return f"SELECT {keys}, CAST(i - 1 AS INTEGER) AS i, round({column}[i], 5) AS x FROM {rows}, (SELECT unnest(range(1, {n + 1})) AS i)"


def _degree_features(spark, sf):
    d = sn.degrees(snapped(spark, sf))
    return d.select("snap", "node", F.array(F.log1p("in_deg"), F.log1p("out_deg")).alias("feat"))


FEATS = f"{SNAP}, {DEG}, fe AS (SELECT snap, node, [ln(1 + in_deg), ln(1 + out_deg)] AS x FROM deg)"
SERIES = "x AS (SELECT node, snap, x, row_number() OVER (PARTITION BY node ORDER BY snap) AS rn FROM {t})"
GRU = {"wi": fixed_weights(1, 2, 12), "wh": fixed_weights(2, 4, 12), "bi": fixed_weights(3, 12), "bh": fixed_weights(4, 12)}
LSTM = {"wi": fixed_weights(1, 2, 16), "wh": fixed_weights(2, 4, 16), "bi": fixed_weights(3, 16), "bh": fixed_weights(4, 16)}


@query("gru_states", f"WITH RECURSIVE {FEATS}, {SERIES.format(t='fe')}, {_sql_fold(_sql_gru('x', 'h', GRU, 4, 'new'), 4)} {_sql_entries('st', 'h', 'node, snap', 4)}")
def gru_states(spark, sf):
    """A recurrent fold over each node's degrees."""
    return _entries(ms.recurrent(_degree_features(spark, sf), GRU), "state", "node", "snap")


@query("lstm_states", f"WITH RECURSIVE {FEATS}, {SERIES.format(t='fe')}, {_sql_fold([*_sql_lstm('x', 'h[1:4]', 'h[5:8]', LSTM, 4, 'n'), {'new': 'list_concat(h_n, c_n)'}], 8)} {_sql_entries('st', 'h', 'node, snap', 4)}")
def lstm_states(spark, sf):
    """In blocks of three snapshots, each with the states of the one before."""
    return _entries(ms.recurrent(_degree_features(spark, sf), LSTM, "lstm", block=3), "state", "node", "snap")


NORMED = """be AS (SELECT snap, src, dst, weight FROM sn UNION ALL SELECT snap, dst, src, weight FROM sn), bi AS (SELECT snap, dst, sum(weight) AS d FROM be GROUP BY ALL), bo AS (SELECT snap, src, sum(weight) AS d FROM be GROUP BY ALL),
    nm AS (SELECT snap, src, dst, weight / (sqrt(greatest(bi.d, 1e-12)) * sqrt(greatest(bo.d, 1e-12))) AS norm FROM be JOIN bi USING (snap, dst) JOIN bo USING (snap, src))"""


def _sql_pass(rows: str, n: int, name: str, out: str = "s") -> str:
    """Messages of rows (snap, node, x) along nm, with a map of the summed list s."""
    return f"{name} AS (SELECT snap, node, {out} AS x FROM (SELECT snap, node, list(v ORDER BY i) AS s FROM (SELECT nm.snap, nm.dst AS node, i, sum(norm * x[i]) AS v FROM nm JOIN {rows} h ON h.snap = nm.snap AND h.node = nm.src, (SELECT unnest(range(1, {n + 1})) AS i) GROUP BY ALL) GROUP BY ALL))"


def _sql_stack(weights: list[np.ndarray], name: str) -> str:
    one, two = weights
    relu = f"list_transform({_sql_linear('s', one)}, lambda t: greatest(t, 0.0))"
    return f"{NORMED}, {_sql_pass('fe', one.shape[0], f'{name}_1', relu)}, {_sql_pass(f'{name}_1', two.shape[0], name, _sql_linear('s', two))}"


def _both_ways(spark, sf):
    g = snapped(spark, sf).select("snap", "src", "dst", "weight")
    return pt.gcn_norm(g.union(g.select("snap", "dst", "src", "weight")), ["snap"])


GCN = [fixed_weights(5, 2, 4), fixed_weights(6, 4, 2)]


@query("gcn_stack", f"WITH {FEATS}, {_sql_stack(GCN, 'gs')} {_sql_entries('gs', 'x', 'snap, node', 2)}")
def gcn_stack(spark, sf):
    """Two layers over each snapshot, edges both ways."""
    return _entries(ms.gcn_stack(_both_ways(spark, sf), _degree_features(spark, sf), GCN, ["snap"]), "feat", "snap", "node")


def _dense(width: int) -> str:
    return f"al AS (SELECT node, snap, coalesce(x, {_sql_list([0] * width)}) AS x FROM (SELECT node, snap FROM (SELECT DISTINCT node FROM deg), (SELECT unnest(range({SNAPS})) AS snap)) LEFT JOIN gs USING (node, snap))"


TGCN = {"gcn": [fixed_weights(7, 2, 4), fixed_weights(8, 4, 9)], **{k: fixed_weights(9 + i, 6, 3) for i, k in enumerate("urc")}, **{f"b{k}": fixed_weights(12 + i, 3) for i, k in enumerate("urc")}}


def _sql_gate(part: int, other: str, name: str) -> str:
    return _sql_linear(f"list_concat(x[{3 * part + 1}:{3 * part + 3}], {other})", TGCN[name], TGCN[f"b{name}"])


TGCN_LEVELS = [{"u": _sql_gate(0, "h", "u"), "r": _sql_gate(1, "h", "r")}, {"c": _sql_gate(2, _sql_each(3, f"{_sigm('r[i]')} * h[i]"), "c")}, {"new": _sql_each(3, f"{_sigm('u[i]')} * h[i] + (1 - {_sigm('u[i]')}) * {_tanh('c[i]')}")}]


@query("tgcn_states", f"WITH RECURSIVE {FEATS}, {_sql_stack(TGCN['gcn'], 'gs')}, {_dense(9)}, {SERIES.format(t='al')}, {_sql_fold(TGCN_LEVELS, 3)} {_sql_entries('st', 'h', 'node, snap', 3)}")
def tgcn_states(spark, sf):
    """Graph convolution gates and a recurrent unit, every node in every snapshot."""
    f = _degree_features(spark, sf)
    return _entries(ms.tgcn(_both_ways(spark, sf), f, TGCN, f.select("node").distinct(), SNAPS), "state", "node", "snap")


MPNN = {"gcn": [fixed_weights(15, 2, 4), fixed_weights(16, 4, 3)], "first": {"wi": fixed_weights(17, 3, 12), "wh": fixed_weights(18, 3, 12), "bi": fixed_weights(19, 12), "bh": fixed_weights(20, 12)}, "second": {"wi": fixed_weights(21, 3, 12), "wh": fixed_weights(22, 3, 12), "bi": fixed_weights(23, 12), "bh": fixed_weights(24, 12)}}
MPNN_LEVELS = [*_sql_lstm("x", "h[1:3]", "h[4:6]", MPNN["first"], 3, "p"), *_sql_lstm("h_p", "h[7:9]", "h[10:12]", MPNN["second"], 3, "q"), {"new": "list_concat(list_concat(h_p, c_p), list_concat(h_q, c_q))"}]


@query("mpnn_lstm_states", f"WITH RECURSIVE {FEATS}, {_sql_stack(MPNN['gcn'], 'gs')}, {_dense(3)}, {SERIES.format(t='al')}, {_sql_fold(MPNN_LEVELS, 12)} {_sql_entries('st', 'h', 'node, snap', 12)}")
def mpnn_lstm_states(spark, sf):
    """Graph convolution and two LSTM cells; all four parts of the state."""
    f = _degree_features(spark, sf)
    return _entries(ms.mpnn_lstm(_both_ways(spark, sf), f, MPNN, f.select("node").distinct(), SNAPS, block=5), "state", "node", "snap")


EVOLVE = {"start": fixed_weights(25, 2, 3), "pool": fixed_weights(26, 2, 2), "bpool": fixed_weights(27, 2), "cell": {**{k: fixed_weights(28 + i, 5, 3) for i, k in enumerate("zrh")}, **{f"b{k}": fixed_weights(31 + i, 3) for i, k in enumerate("zrh")}}}


def _sql_evolve() -> str:
    """Matrices by snapshot, their rows one after the other as the state h of one node."""
    gate = lambda k, row, other: _sql_linear(f"list_concat(x, {other})", EVOLVE["cell"][k], EVOLVE["cell"][f"b{k}"])
    rows = [(j, f"h[{3 * j + 1}:{3 * j + 3}]") for j in range(2)]
    one = {f"{k}{j}": gate(k, j, row) for k in "zr" for j, row in rows}
    two = {f"n{j}": gate("h", j, _sql_each(3, f"{_sigm(f'r{j}[i]')} * ({row})[i]")) for j, row in rows}
    new = [_sql_each(3, f"{_sigm(f'z{j}[i]')} * ({row})[i] + (1 - {_sigm(f'z{j}[i]')}) * {_tanh(f'n{j}[i]')}") for j, row in rows]
    fold = _sql_fold([one, two, {"new": f"list_concat({new[0]}, {new[1]})"}], 6)
    return fold.replace(f"{_sql_list([0] * 6)} AS h FROM x", f"{_sql_list(EVOLVE['start'].ravel())} AS h FROM x")


EVOLVE_X = f"""po AS (SELECT snap, list(v ORDER BY i) AS p FROM (SELECT snap, i, sum(x[i]) / (SELECT count(DISTINCT node) FROM deg) AS v FROM fe, (SELECT unnest([1, 2]) AS i) GROUP BY ALL) GROUP BY ALL),
    x AS (SELECT 0 AS node, snap, {_sql_linear('p', EVOLVE['pool'], EVOLVE['bpool'])} AS x, row_number() OVER (ORDER BY snap) AS rn FROM po)"""


@query("evolvegcn_outputs", f"""WITH RECURSIVE {FEATS}, {NORMED}, {EVOLVE_X}, {_sql_evolve()}, {_sql_pass('fe', 2, 'gs')},
    o AS (SELECT gs.snap, gs.node, {_sql_each(3, 'gs.x[1] * st.h[i] + gs.x[2] * st.h[3 + i]')} AS x FROM gs JOIN st ON st.snap = gs.snap) {_sql_entries('o', 'x', 'snap, node', 3)}""")
def evolvegcn_outputs(spark, sf):
    """Messages of each snapshot times its own evolved matrix."""
    f = _degree_features(spark, sf)
    return _entries(ms.evolvegcn(_both_ways(spark, sf), f, EVOLVE, f.select("node").distinct().count()), "feat", "snap", "node")


MEMORY = {"mail": {"wi": fixed_weights(34, 3, 12), "wh": fixed_weights(35, 4, 12), "bi": fixed_weights(36, 12), "bh": fixed_weights(37, 12)}, "cell": {"wi": fixed_weights(38, 4, 12), "wh": fixed_weights(39, 4, 12), "bi": fixed_weights(40, 12), "bh": fixed_weights(41, 12)}}


def _sql_memory() -> str:
    rows = "SELECT * FROM me"
    h = _sql_list([0] * 4)
    for k in range(SLOTS):
        for level in _sql_gru(f"m{k}", h, MEMORY["mail"], 4, f"h{k}"):
            rows = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in level.items())} FROM ({rows})"
        h = f"h{k}"
    for level in _sql_gru(h, "memory", MEMORY["cell"], 4, "new"):
        rows = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in level.items())} FROM ({rows})"
    return rows


MEMORY_ROWS = f"""{MAIL}, s AS (SELECT node, slot, max_by({{'eid': last.eid, 'peer': last.peer}}, batch * 2 + side) AS m FROM wr GROUP BY ALL),
    ml AS (SELECT node, slot, [(node % 5)::DOUBLE, (m.peer % 5)::DOUBLE, weight] AS v FROM s JOIN ev ON ev.eid = m.eid),
    me AS (SELECT node, {', '.join(f'coalesce(max(v) FILTER (slot = {k}), {_sql_list([0] * 3)}) AS m{k}' for k in range(SLOTS))}, list_transform(range(4), lambda j: ((node + j) % 3)::DOUBLE) AS memory FROM ml GROUP BY node)"""


@query("memory_updated", f"WITH {MEMORY_ROWS}, u AS ({_sql_memory()}) {_sql_entries('u', 'new', 'node', 4)}")
def memory_updated(spark, sf):
    """A recurrent unit over the slots of each node's mailbox, then a cell with its memory."""
    nodes = node_parts(spark, sf)
    own = nodes.select("node", F.array((F.col("node") % 5).cast("double")).alias("memory"))
    mail = st.messages(st.mailbox(_train(spark, sf), SLOTS), own, graph(spark, sf).select("eid", F.array("weight").alias("feat")), 1)
    memory = nodes.select("node", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: ((F.col("node") + j) % 3).cast("double")).alias("memory"))
    return _entries(ms.memory_update(mail.select("node", "slot", "mail"), memory, MEMORY, SLOTS), "memory", "node")


ATTEND = {"q": fixed_weights(42, 6, 4), "k": fixed_weights(43, 7, 4), "v": fixed_weights(44, 7, 4), "out": fixed_weights(45, 6, 4), **{f"b{k}": fixed_weights(46 + i, 4) for i, k in enumerate("qkv")}, "bout": fixed_weights(49, 4)}
NODE_FEATS = "nf AS (SELECT node, [ln(1 + sum(i)), ln(1 + sum(o))] AS x FROM (SELECT src AS node, 0.0::DOUBLE AS i, weight AS o FROM ev UNION ALL SELECT dst, weight, 0.0::DOUBLE FROM ev) GROUP BY ALL)"
ENCODED = "list_transform(range(4), lambda t: cos({dt} * pow(10.0, -9.0 * t / 3)))"
ATTENTION = f"""{ROOTS}, {NODE_FEATS}, r AS ({OF_ROOTS.format(r='ro')}), nb AS (SELECT * FROM r WHERE rank <= {K}),
    ke AS (SELECT nb.root, nb.root_ts, nbr_eid, list_concat(list_concat(b.x, [ev.weight]), {ENCODED.format(dt='(nb.dt / 1e9)')}) AS key, list_concat(a.x, {ENCODED.format(dt='0.0')}) AS query
           FROM nb JOIN nf a ON a.node = nb.root JOIN nf b ON b.node = nb.nbr JOIN ev ON ev.eid = nb.nbr_eid),
    kq AS (SELECT root, root_ts, nbr_eid, {_sql_linear('query', ATTEND['q'], ATTEND['bq'])} AS q, {_sql_linear('key', ATTEND['k'], ATTEND['bk'])} AS k, {_sql_linear('key', ATTEND['v'], ATTEND['bv'])} AS v FROM ke),
    sc AS (SELECT root, root_ts, nbr_eid, v, h, q[2 * h + 1] * k[2 * h + 1] + q[2 * h + 2] * k[2 * h + 2] AS s FROM kq, (SELECT unnest([0, 1]) AS h)),
    ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY root, root_ts, h)) AS e FROM (SELECT *, CASE WHEN s < 0 THEN 0.2 * s ELSE s END AS z FROM sc)),
    hd AS (SELECT root, root_ts, 2 * h + j AS i, sum(e * v[2 * h + j]) / sum(e) AS x FROM ex, (SELECT unnest([1, 2]) AS j) GROUP BY ALL),
    ag AS (SELECT root, root_ts, list(x ORDER BY i) AS agg FROM hd GROUP BY ALL),
    all_roots AS (SELECT DISTINCT root, root_ts FROM ro),
    ou AS (SELECT root, root_ts, list_transform({_sql_linear(f'list_concat(coalesce(agg, {_sql_list([0] * 4)}), nf.x)', ATTEND['out'], ATTEND['bout'])}, lambda t: greatest(t, 0.0)) AS y FROM all_roots LEFT JOIN ag USING (root, root_ts) JOIN nf ON nf.node = root),
    mn AS (SELECT *, list_avg(y) AS m FROM ou), nr AS (SELECT root, root_ts, {_sql_each(4, '(y[i] - m) / sqrt(list_avg(list_transform(y, lambda t: (t - m) * (t - m))) + 1e-5)')} AS x FROM mn)"""


def _attended(spark, sf):
    """Two heads over the latest neighbours of the validation batches' roots."""
    g = graph(spark, sf)
    nodes = sn.degrees(g.withColumn("snap", F.lit(0))).select("node", F.array(F.log1p("in_deg"), F.log1p("out_deg")).alias("feat"))
    roots = _val_roots(spark, sf)
    near = tp.recent_k_of(roots, g, K).withColumn("dt", F.col("dt") / F.lit(1e9))
    return ms.temporal_attention(near, nodes, g.select("eid", F.array("weight").alias("feat")), ATTEND, 2, 4, roots)


@query("temporal_attention", f"WITH {ATTENTION} {_sql_entries('nr', 'x', 'root, root_ts', 4)}")
def temporal_attention(spark, sf):
    return _entries(_attended(spark, sf), "feat", "root", "root_ts")


CLASSIFY = {"hidden": fixed_weights(61, 2, 5), "bhidden": fixed_weights(62, 5), "out": fixed_weights(63, 5, 3), "bout": fixed_weights(64, 3)}


@query("node_classes", f"""WITH {FEATS}, h AS (SELECT snap, node, list_transform({_sql_linear('x', CLASSIFY['hidden'], CLASSIFY['bhidden'])}, lambda t: greatest(t, 0.0)) AS h FROM fe),
    l AS (SELECT snap, node, {_sql_linear('h', CLASSIFY['out'], CLASSIFY['bout'])} AS z FROM h)
    SELECT snap, node, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted, round(list_max(z), 5) AS logit FROM l""")
def node_classes(spark, sf):
    """Classes of nodes in each snapshot from their degrees."""
    return ms.classify(_degree_features(spark, sf), CLASSIFY).select("snap", "node", "predicted", F.round(F.array_max("logits"), 5).alias("logit"))


PREDICT = {"src": fixed_weights(50, 4, 4), "dst": fixed_weights(51, 4, 4), "out": fixed_weights(52, 4, 1), "bsrc": fixed_weights(53, 4), "bdst": fixed_weights(54, 4), "bout": fixed_weights(55, 1)}


@query("link_logits", f"""WITH {ATTENTION}, pa AS (SELECT DISTINCT src, dst, l.root_ts FROM ba JOIN last l ON l.batch = ba.batch WHERE split = 'val'),
    lg AS (SELECT src, dst, pa.root_ts, {_sql_linear('a.x', PREDICT['src'], PREDICT['bsrc'])} AS s, {_sql_linear('b.x', PREDICT['dst'], PREDICT['bdst'])} AS d FROM pa JOIN nr a ON a.root = src AND a.root_ts = pa.root_ts JOIN nr b ON b.root = dst AND b.root_ts = pa.root_ts)
    SELECT src, dst, root_ts, round(({_sql_linear(_sql_each(4, 'greatest(s[i] + d[i], 0.0)'), PREDICT['out'], PREDICT['bout'])})[1], 5) AS logit FROM lg""")
def link_logits(spark, sf):
    """Scores of the validation events' pairs from both ends' attention."""
    found = _attended(spark, sf)
    val = split(spark, sf).where("split = 'val'")
    pairs = val.join(val.groupBy("batch").agg(F.max("ts").alias("root_ts")), "batch").select("src", "dst", "root_ts").distinct()
    both = pairs.join(found.toDF("src", "root_ts", "src_feat"), ["src", "root_ts"]).join(found.toDF("dst", "root_ts", "dst_feat"), ["dst", "root_ts"])
    return ms.link_logits(both, PREDICT).select("src", "dst", "root_ts", F.round("logit", 5).alias("logit"))


# Epochs of named models


def _model_session(spark, sf, mode: str, model: str, **settings) -> Session:
    g = graph(spark, sf)
    s = Session.from_config(spark, {"mode": mode, "model": model, "parts": PARTS, "snaps": SNAPS, **settings}, g, _folder(spark))
    s.prepare_data()
    return s.build_runtime()


@query("session_memory_epoch", eq.memory_epoch_sql({"split": SPLIT, "ids": IDS}, {"linear": _sql_linear, "gru": _sql_gru, "list": _sql_list, "each": _sql_each}))
def session_memory_epoch(spark, sf):
    """Memory, mailbox, attention and link scores over five batches of events."""
    batch = max(1, table(spark, sf, "events").count() // 4)
    return eq.memory_epoch(_model_session(spark, sf, "ctdg", "tgn", batch_size=batch, dim=4, neighbours=[K], slots=SLOTS))


SEQUENCE = eq.sequence_weights(TGCN)
DIRECTED = f"{NORMED}, {_sql_pass('fe', 2, 'gs_1', 'list_transform(' + _sql_linear('s', TGCN['gcn'][0]) + ', lambda t: greatest(t, 0.0))')}, {_sql_pass('gs_1', 4, 'gs', _sql_linear('s', TGCN['gcn'][1]))}".replace(" UNION ALL SELECT snap, dst, src, weight FROM sn", "")


@query("session_snapshot_epoch", eq.snapshot_epoch_sql(f"{DIRECTED}, {_dense(9)}, {SERIES.format(t='al')}, {_sql_fold(TGCN_LEVELS, 3)}", SEQUENCE, SNAPS, FEATS))
def session_snapshot_epoch(spark, sf):
    """A snapshot model over all splits, node states handed from window to window."""
    return eq.snapshot_epoch(_model_session(spark, sf, "dtdg", "tgcn", dim=3, window=3), SEQUENCE)


# Partitioners, draws by mass, decayed windows, stored adjacency


@query("weighted_k", f"""WITH {EV}, m AS (SELECT src, eid, dst, ts, greatest(0, CAST(floor(weight) AS BIGINT)) AS m FROM ev), r AS (SELECT DISTINCT src AS root, ts AS root_ts FROM ev),
    s AS (SELECT *, sum(m) OVER (PARTITION BY src ORDER BY ts, eid) - m AS first FROM m),
    t AS (SELECT root, root_ts, CAST(sum(m) AS BIGINT) AS total FROM r JOIN m ON src = root AND ts < root_ts GROUP BY ALL HAVING sum(m) > 0),
    o AS (SELECT *, ((root % 2147483647) * 31 + root_ts % 2147483647) % 2147483647 AS own FROM t),
    d AS (SELECT root, root_ts, rank, ((own * 16807 + rank * 104729 + 7) % 2147483647 * 2147483647 + (own * 48271 + rank * 7919 + 7) % 2147483647) % total AS place FROM o, (SELECT unnest(range(1, 4)) AS rank))
    SELECT root, root_ts, eid AS nbr_eid, dst AS nbr, root_ts - ts AS dt, rank FROM d JOIN s ON src = root AND place >= first AND place < first + m""")
def weighted_k(spark, sf):
    """Three draws by mass for the sources of all events at their times."""
    g = graph(spark, sf)
    return tp.weighted_k_of(g.select(F.col("src").alias("root"), F.col("ts").alias("root_ts")), g.withColumn("mass", F.floor("weight")), 3)


@query("decayed_windows", f"""WITH {SNAP}, no AS (SELECT DISTINCT node FROM (SELECT src AS node FROM ev UNION ALL SELECT dst FROM ev)), pl AS (SELECT node, row_number() OVER (ORDER BY 3 - node % 4, node) - 1 AS place, 3 - node % 4 AS rank FROM no),
    en AS (SELECT count(*) FILTER (rank < 1) AS e1, count(*) FILTER (rank < 2) AS e2 FROM pl),
    ed AS (SELECT snap, eid, greatest(a.place, b.place) AS reach FROM sn JOIN pl a ON a.node = src JOIN pl b ON b.node = dst)
    SELECT snap + age AS at, age, count(*) AS n, CAST(sum(eid) AS BIGINT) AS eids FROM ed, en, (SELECT unnest(range(3)) AS age) WHERE snap + age < {SNAPS} AND reach < CASE age WHEN 0 THEN 1e18 WHEN 1 THEN e2 ELSE e1 END GROUP BY ALL""")
def decayed_windows(spark, sf):
    """Windows of three snapshots whose older ones keep the first two chunks, then one."""
    nodes = node_parts(spark, sf).withColumn("chunk", F.pmod("node", F.lit(4)).cast("int"))
    rank = pt.chunk_order("reverse", 4)
    ends = [r["end"] for r in pt.chunk_ends(nodes, rank).orderBy("rank").collect()]  # a row for each chunk
    places = pt.permuted(nodes.withColumn("all", F.lit(0)), rank, "all").select("node", "place")
    kept = sn.decayed_windows(snapped(spark, sf).select("snap", "eid", "src", "dst"), places, sn.decayed_ends(ends, pt.chunk_decay(2, 4), 3), SNAPS)
    return kept.groupBy("at", "age").agg(F.count("*").alias("n"), F.sum("eid").alias("eids"))


@query("adjacency_stored", f"WITH {EV}, d AS (SELECT src, count(*) AS degree FROM ev GROUP BY ALL) SELECT ev.src AS node, dst AS nbr, eid, degree FROM ev JOIN d USING (src) WHERE ev.src % 3 <> 0")
def adjacency_stored(spark, sf):
    """Neighbours from the bucketed table, with their nodes' degrees."""
    stored = Adjacency.write(graph(spark, sf), 8)
    asked = graph(spark, sf).select(F.col("src").alias("node")).where("node % 3 != 0").distinct()
    return stored.neighbours(asked).join(stored.degrees(), "node").select("node", "nbr", "eid", "degree")


@query("streaming_cut", eq.streaming_cut_sql(EV, PARTS, 4, 1e-13, _sql_mixed))
def streaming_cut(spark, sf):
    """Edges placed by the copies, decayed degrees and loads that earlier batches left."""
    return vc.streaming_cut(numbered(spark, sf), PARTS, 4, 1e-13)[1]


@query("multilevel_parts", f"WITH {EV} SELECT CAST(p AS INTEGER) AS part, TRUE AS in_room, n AS nodes, n AS placed, TRUE AS cut_below_hash FROM (SELECT count(DISTINCT node) AS n FROM (SELECT src AS node FROM ev UNION ALL SELECT dst FROM ev)), (SELECT unnest(range({PARTS})) AS p)")
def multilevel_parts(spark, sf):
    """Whether each part is within a tenth of its share, every node stands in one part, and
    fewer edges cross than with hashed parts; the parts themselves have no SQL."""
    g = materialise(graph(spark, sf).select("src", "dst"))  # read by every step
    found = materialise(ml.multilevel(g, PARTS))
    hashed = [pt.hashed(F.col(end), PARTS) for end in ("src", "dst")]
    better = pt.cross_ratio(g, found).first()[0] < g.agg(F.avg((hashed[0] != hashed[1]).cast("double"))).first()[0]
    n = g.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    limit = -(-n * 1.1 // PARTS)
    placed = found.select("node").distinct().count() if found.count() == n else -1
    sizes = spark.range(PARTS).select(F.col("id").cast("int").alias("part")).join(found.groupBy("part").agg(F.count("*").alias("size")), "part", "left")
    return sizes.select("part", (F.coalesce("size", F.lit(0)) <= limit).alias("in_room"), F.lit(n).cast("long").alias("nodes"), F.lit(placed).cast("long").alias("placed"), F.lit(better).alias("cut_below_hash"))
