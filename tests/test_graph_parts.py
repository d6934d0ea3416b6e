"""Partitioners, draws by mass, information-aware slices, decayed windows, stored adjacency."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import multilevel as ml
from chronoloom.operators import partitioning as pt
from chronoloom.operators import sampling as sp
from chronoloom.operators import snapshots as sn
from chronoloom.operators import temporal as tp
from chronoloom.operators import vertex_cut as vc
from chronoloom.sources.adjacency import BLOCK, Adjacency


@pytest.fixture(scope="module")
def planted(spark):
    """Four communities of 40 nodes, and one hub that everything knows."""
    rng = random.Random(1)
    pairs = [(a, rng.randrange(40) + a // 40 * 40 if rng.random() < 0.9 else rng.randrange(160)) for a in range(160) for _ in range(5)]
    pairs += [(a, 999) for a in range(160)]
    rng.shuffle(pairs)
    return spark.createDataFrame([(i, a, b, float(i), i) for i, (a, b) in enumerate(pairs)], "eid long, src long, dst long, ts double, rn long").cache()


def cut(edges, parts):
    at = {r["node"]: r["part"] for r in parts.collect()}
    rows = edges.collect()
    return sum(at[r["src"]] != at[r["dst"]] for r in rows) / len(rows), Counter(at.values())


def test_multilevel_finds_planted_communities(spark, planted):
    edges = planted.where("dst != 999")
    ratio, sizes = cut(edges, ml.multilevel(edges, 4))
    plain, _ = cut(edges, pt.label_propagation(edges, 4))
    assert ratio < 0.12 and ratio < plain / 2
    assert sum(sizes.values()) == 160 and max(sizes.values()) <= 44


def test_multilevel_deals_out_a_star_within_its_slack(spark, planted):
    star = planted.where("dst = 999")
    _, sizes = cut(star, ml.multilevel(star, 4))
    assert sum(sizes.values()) == 161 and max(sizes.values()) <= 45
    assert ml.multilevel(star.where("false"), 4).count() == 0


def test_a_level_matches_pairs_along_heavy_edges(spark):
    nodes = spark.createDataFrame([(i, 1) for i in range(7)], "node long, weight long")
    edges = spark.createDataFrame([(0, 1, 9), (1, 2, 1), (2, 3, 8), (0, 4, 1), (0, 5, 1)], "u long, v long, w long")
    to = {r["node"]: r["to"] for r in ml.matched(nodes, edges, 2).collect()}
    assert to == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}  # 4 and 5 were turned down by the same node
    heavier, links = ml.contracted(nodes, edges, ml.matched(nodes, edges, 2))
    assert {r["node"]: r["weight"] for r in heavier.collect()} == {0: 2, 2: 2, 4: 2, 6: 1}
    assert {(r["u"], r["v"]): r["w"] for r in links.collect()} == {(0, 2): 1, (0, 4): 2}
    assert set(to) == {r["node"] for r in ml.matched(nodes, edges, 1).where("node = to").collect()}


def brute_cut(rows, parts, batches, decay):
    per, state, loads, out = -(-len(rows) // batches), {}, [0] * parts, {}
    for b in range(0, len(rows), per):
        batch = rows[b : b + per]
        now = max(r["ts"] for r in batch)
        times = Counter(x for r in batch for x in (r["src"], r["dst"]))
        known = {}
        for n, k in times.items():
            own, degree, seen = state.get(n, (set(), 0.0, now))
            known[n] = (own, round(degree * 2.718281828459045 ** (-decay * (now - seen)) + k, 9))
        low, high = min(loads), max(loads)
        placed = []
        for r in batch:
            (a, da), (c, dc) = known[r["src"]], known[r["dst"]]
            share = da / (da + dc)
            if not a and not c:
                x = r["src"] if da <= dc else r["dst"]
                p = (x * 48271 + 11) % 2147483647 % parts
            else:
                p = max(range(parts), key=lambda i: (round((2 - share) * (i in a) + (1 + share) * (i in c) + (high - loads[i]) / (1 + high - low), 9), -i))
            placed.append((r, p))
        for r, p in placed:
            out[r["eid"]] = p
            loads[p] += 1
        for n, (own, degree) in known.items():
            state[n] = (own | {p for r, p in placed if n in (r["src"], r["dst"])}, degree, now)
    return out, {n: sorted(v[0]) for n, v in state.items()}


def test_streaming_cut_equals_brute_force_and_copies_less(spark, planted):
    nodes, edges = vc.streaming_cut(planted, 4, 8, 0.001)
    expected, copies = brute_cut(sorted(planted.collect(), key=lambda r: r["rn"]), 4, 8, 0.001)
    assert {r["eid"]: r["part"] for r in edges.collect()} == expected
    assert {r["node"]: r["parts"] for r in nodes.collect()} == copies
    hot = pt.hot_aware(planted, 4)[0].groupBy("node").count().agg(F.avg("count")).first()[0]
    assert sum(map(len, copies.values())) / len(copies) < hot
    assert max(Counter(expected.values()).values()) < 2 * len(expected) / 4
    assert vc.streaming_cut(planted.where("false"), 4)[1].count() == 0


def test_draws_follow_masses(spark):
    rows = [(i, 1, i, 10 * i, m) for i, m in enumerate([1, 0, 5000, 3, 1, 0, None, 2, 40])] + [(50, 2, 7, 5, 0)]
    edges = spark.createDataFrame(rows, "eid long, src long, dst long, ts long, mass long")
    roots = spark.createDataFrame([(1, 35), (1, 1000), (1, 0), (2, 99), (3, 5)], "root long, root_ts long")
    got = tp.weighted_k_of(roots, edges, 400).collect()
    assert Counter((r["root"], r["root_ts"]) for r in got) == {(1, 35): 400, (1, 1000): 400}
    early = Counter(r["nbr_eid"] for r in got if r["root_ts"] == 35)
    assert set(early) <= {0, 2, 3} and early[2] > 350
    assert {r["nbr_eid"] for r in got} <= {0, 2, 3, 4, 7, 8} and all(r["dt"] == r["root_ts"] - 10 * r["nbr"] > 0 for r in got)


def test_one_draw_each_covers_all_events_of_equal_mass(spark):
    edges = spark.range(3000).select(F.col("id").alias("eid"), F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.col("id").alias("ts"), F.lit(7).cast("long").alias("mass"))
    roots = spark.createDataFrame([(1, 3000 + i) for i in range(300)], "root long, root_ts long")
    each = Counter(r["nbr_eid"] // 300 for r in tp.weighted_k_of(roots, edges, 10).collect())
    assert sum(each.values()) == 3000 and min(each.values()) > 200 and max(each.values()) < 420


def test_information_aware_slices(spark):
    pairs = [(1, 2), (1, 2), (3, 4), (1, 2), (5, 6), (3, 4), (7, 8), (9, 9)]
    rows = spark.createDataFrame([(10 + i, a, b, i) for i, (a, b) in enumerate(pairs)], "eid long, src long, dst long, rn long")
    got = {r["eid"] - 10: r for r in sn.novelty_events(rows, 2, window_size=2, drop_rate=1.0).collect()}
    assert [i for i in range(8) if not got[i]["kept"]] == [1, 3]  # the pair of 5 came three events before
    assert [got[2 * b]["score"] for b in range(4)] == [0.25, 0.25, 1.0, 1.0]
    assert [got[2 * b]["slice"] for b in range(4)] == [0, 0, 0, 1]
    assert all(r["kept"] for r in sn.novelty_events(rows, 2).collect())
    assert len(sn.novelty_cuts(rows, 2).collect()) == 4


def test_decayed_windows_cut_older_snapshots(spark):
    assert sn.decayed_ends([10, 20, 30], [1, 2], 4) == [None, 20, 10, 10] and sn.decayed_ends([10], [], 2) == [None, None]
    edges = spark.createDataFrame([(s, s * 10 + i, i, (i + 1) % 4) for s in range(3) for i in range(4)], "snap long, eid long, src long, dst long")
    places = spark.createDataFrame([(i, i) for i in range(4)], "node long, place long")
    got = {(r["at"], r["age"]): r["eids"] for r in sn.decayed_windows(edges, places, [None, 3, 2], 3).groupBy("at", "age").agg(F.sort_array(F.collect_list("eid")).alias("eids")).collect()}
    assert got == {(0, 0): [0, 1, 2, 3], (1, 0): [10, 11, 12, 13], (2, 0): [20, 21, 22, 23], (1, 1): [0, 1], (2, 1): [10, 11], (2, 2): [0]}
    now = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [9.0])], "node long, state array<double>")
    old = spark.createDataFrame([(1, [5.0]), (2, [6.0]), (3, [7.0])], "node long, state array<double>")
    assert {r["node"]: r["state"][0] for r in sn.window_mixed(now, old, places, 2, 4, 1).collect()} == {0: 1.0, 1: 2.0, 2: 6.0, 3: 7.0}
    assert {r["node"]: r["state"][0] for r in sn.window_mixed(now, old, places, None, 2, 1).collect()} == {0: 1.0, 1: 2.0}


def test_stored_adjacency_is_joined_where_it_lies(spark):
    edges = spark.range(5000).select(F.col("id").alias("eid"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("src"), (F.col("id") % 97).alias("dst"))
    stored = Adjacency.write(edges, 4)
    assert stored.rows().where("node = 0").count() >= 3 and stored.rows().agg(F.max("n")).first()[0] <= BLOCK
    nodes = spark.range(0, 50, 7).select(F.col("id").alias("node"))
    rows = {(r["src"], r["dst"], r["eid"]) for r in edges.collect()}
    assert {tuple(r) for r in stored.neighbours(nodes).collect()} == {x for x in rows if x[0] % 7 == 0}
    assert {tuple(r) for r in stored.subgraph(nodes).collect()} == {x for x in rows if x[0] % 7 == 0 and x[1] in range(0, 50, 7)}
    assert dict(map(tuple, stored.degrees().collect())) == Counter(x[0] for x in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = stored.neighbours(nodes)._jdf.queryExecution().sparkPlan().toString() and stored.neighbours(nodes)._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("Join") :]
        scan = side.index("FileScan")
        assert "Exchange" not in side[:scan] and "Bucketed: true" in side[scan:]
        assert "Exchange" not in stored.degrees()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stored.drop()


def test_large_ids_are_drawn_for(spark):
    edges = spark.createDataFrame([(10**15 + i, 1, 5 + i % 3, i) for i in range(9)], "eid long, src long, dst long, ts long")
    got = sp.negatives(edges, sp.pool(edges)).collect()
    assert len(got) == 9 and all(r["neg"] != r["dst"] for r in got)
    assert tp.uniform_k(edges, 2).count() == 16


def test_multilevel_reads_each_level_from_one_written_table(spark, planted, monkeypatch):
    held, read = ml._held, []
    monkeypatch.setattr(ml, "_held", lambda edges, at: read.append(getattr(edges, "_chronoloom_path", None)) or held(edges, at))
    nodes, links = ml.graph_of(planted)
    at = nodes.withColumn("part", pt.hashed(F.col("node"), 4))
    ml.refined(ml.materialise(at), links, 4, 44, 3)
    assert len(read) >= 2 and len(set(read)) == 1 and read[0]
