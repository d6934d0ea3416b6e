"""Small fixtures with results worked out by hand, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import metrics as mt
from chronoloom.operators import events as ev
from chronoloom.operators import messages as ms
from chronoloom.operators import partitioning as pt
from chronoloom.operators import sampling as sp
from chronoloom.operators import snapshots as sn
from chronoloom.operators import state as st
from chronoloom.operators import temporal as tp
from chronoloom.plans.session import Session
from chronoloom.sources import artifacts, edges


def sets(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def ring(spark):
    return ev.with_row_number(edges.ring_events(spark, 4), "ts", "eid")


def test_equal_count_slices(ring):
    snaps = sn.equal_count(ring, 4)
    assert [tuple(r) for r in sn.snapshot_stats(snaps, 4).orderBy("snap").collect()] == [(0, 4, 0.0, 3.0), (1, 4, 4.0, 7.0), (2, 4, 8.0, 11.0), (3, 4, 12.0, 15.0)]


def test_trailing_snapshot_is_empty(ring):
    five = ring.where("rn < 5")
    snaps = sn.equal_count(five, 4)
    assert [r["n_edges"] for r in sn.snapshot_stats(snaps, 4).orderBy("snap").collect()] == [2, 2, 1, 0]
    assert [r["end_ts"] for r in sn.snapshot_ends(snaps, 4).orderBy("snap").collect()] == [1.0, 3.0, 4.0, 4.0]


def test_degrees_and_label(ring):
    got = sets(sn.degrees(sn.equal_count(ring, 4)).where("snap = 0").select("node", "in_deg", "out_deg", F.round("label", 9)))
    two = round(math.log(2), 9)
    assert got == {(0, 0.0, 1.0, 0.0), (1, 1.0, 1.0, two), (2, 1.0, 1.0, two), (3, 1.0, 1.0, two), (4, 1.0, 0.0, two)}


def test_split_sizes():
    assert ev.split_sizes(10) == [7, 2, 1]
    assert ev.split_sizes(16) == [11, 3, 2]
    assert ev.split_sizes(3) == [1, 1, 1]
    assert [ev.split_bounds(10, s) for s in ev.SPLITS] == [(0, 7), (7, 9), (9, 10)]
    for n in range(60):
        assert sum(ev.split_sizes(n)) == n


def test_edge_lines(spark):
    lines = ["# c", "% c", "", "1 2 5", "1,2,0.5,7", "7,1,2,99,0", "1 2", "2.7 3.9 1"]
    got = sets(edges.parse_edge_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert got == {(1, 2, 5.0, 1.0), (1, 2, 7.0, 0.5), (1, 2, 99.0, 1.0), (2, 3, 1.0, 1.0)}


def test_column_inference():
    assert edges.infer_columns(["src", "dst", "time", "w"]) == ("time", "w")
    assert edges.infer_columns(["src", "dst", "weight", "x"]) == ("x", "weight")
    with pytest.raises(ValueError):
        edges.infer_columns(["a", "b"])


def test_ranged_row_numbers(spark):
    df = spark.range(3000).select(F.pmod(F.col("id") * 7919, F.lit(40)).alias("ts"), F.pmod(F.col("id") * 104729, F.lit(3001)).alias("eid"))
    assert sets(ev.with_row_number(df, "ts", "eid", ranges=9)) == sets(ev.with_row_number(df, "ts", "eid"))


def test_running_sums_in_ranges_and_hot_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(k), int(rng.integers(12)), int(rng.integers(4))) for i, k in enumerate(rng.choice([1, 2, 3], 400, p=[0.8, 0.15, 0.05]))]
    df = spark.createDataFrame(rows, "eid long, src long, ts long, v long")
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {r[0]: sum(x[3] for x in order[:i]) for i, r in enumerate(order)}
    for ranges in (None, 7):
        got = ev.running_total(df, ["ts", "eid"], {"t": F.col("v")}, ranges)
        assert {r["eid"]: r["t"] for r in got.collect()} == want
    for hot_from in (1, 50, 10_000):
        got = {r["eid"]: (r["n"], r["earlier"]) for r in ev.running_in(df, "src", ["ts", "eid"], "n", tie="ts", tie_name="earlier", hot_from=hot_from).collect()}
        assert got == {i: (sum(x[1] == k and (x[2], x[0]) < (t, i) for x in rows), sum(x[1] == k and x[2] < t for x in rows)) for i, k, t, _ in rows}
        got = {r["eid"]: r["s"] for r in ev.running_in(df, "src", ["ts", "eid"], "s", value=F.col("v"), hot_from=hot_from).collect()}
        assert got == {i: sum(x[3] for x in rows if x[1] == k and (x[2], x[0]) < (t, i)) for i, k, t, _ in rows}


@pytest.mark.parametrize("hot_from", [5, 10_000])
def test_hot_keys_change_no_result(spark, hot_from, monkeypatch):
    e = spark.createDataFrame([(i, 0 if i % 5 else i % 7, i % 3, i // 4, float(i)) for i in range(120)], "eid long, src long, dst long, ts long, weight double")
    b = e.withColumn("batch", F.floor(F.col("eid") / 10))
    wanted = [tp.recent_k(e, 3), tp.uniform_k(e, 2), tp.recent_k_of(e.select(F.col("src").alias("root"), F.col("ts").alias("root_ts")), e, 3), st.mailbox(b, 3), pt.permuted(e.select(F.col("eid").alias("node"), (F.col("src") % 2).alias("part"), F.col("dst").alias("chunk")), F.col("chunk"))]
    wanted = [sets(x) for x in wanted]
    monkeypatch.setattr(ev.running_in, "__defaults__", (*ev.running_in.__defaults__[:-1], hot_from))
    got = [tp.recent_k(e, 3), tp.uniform_k(e, 2), tp.recent_k_of(e.select(F.col("src").alias("root"), F.col("ts").alias("root_ts")), e, 3), st.mailbox(b, 3), pt.permuted(e.select(F.col("eid").alias("node"), (F.col("src") % 2).alias("part"), F.col("dst").alias("chunk")), F.col("chunk"))]
    assert [sets(x) for x in got] == wanted


def test_hot_nodes_with_ties(spark):
    e = spark.createDataFrame([(i, i % 10, 100 + i % 3) for i in range(60)], "eid long, src long, dst long")
    degree = {}
    for i in range(60):
        for n in (i % 10, 100 + i % 3):
            degree[n] = degree.get(n, 0) + 1
    for ratio in (0.0, 0.1, 0.5, 1.0):
        want = sorted(degree.items(), key=lambda x: (-x[1], x[0]))[: int(ratio * len(degree))]
        assert sets(pt.hot_nodes(e, ratio)) == set(want)


def test_columns_with_a_value_for_each_row(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 0)], "node long, part int")
    one = spark.createDataFrame([(1, 5), (2, 6)], "node long, x long")
    assert sets(ev.with_values(nodes, one, "node", "x")) == {(1, 0, 5), (2, 0, 6)}
    for wrong in (one.where("node = 1"), one.union(one)):
        with pytest.raises(ValueError):
            ev.with_values(nodes, wrong, "node", "x")
    with pytest.raises(ValueError):
        ev.with_values(nodes, one.withColumnRenamed("x", "part"), "node", "part")


def test_clusters_grow_where_many_edges_cross(spark):
    e = spark.createDataFrame([(i, i % 2, i % 13, (i * 7) % 11, 1.0) for i in range(200)], "eid long, slice long, src long, dst long, weight double")
    got = pt.slice_clusters(e, 2, tries=3)
    assert got.count() == e.selectExpr("slice", "explode(array(src, dst)) as node").distinct().count()
    assert got.agg(F.max("cluster")).first()[0] > 1
    assert pt.slice_clusters(e, 1).agg(F.max("cluster")).first()[0] == 0


def test_halo_and_routes(spark):
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 0), (5, 1)], "node long, part int")
    e = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(5)], "eid long, src long, dst long, weight double")
    halos = pt.halo(e, parts)
    assert sets(halos) == {(0, 3, 1), (1, 1, 0), (1, 4, 0)}
    index = pt.local_index(parts, halos)
    assert sets(pt.send_index(halos, index)) == {(0, 1, 1, 1), (0, 1, 4, 2), (1, 0, 3, 1)}
    assert sets(pt.route_sizes(halos)) == {(0, 1, 2), (1, 0, 1)}
    assert pt.block_edges(e, parts, index).count() == 5


def test_asof(spark):
    h = spark.createDataFrame([(1, 1, "a"), (1, 3, "b")], "node long, ts long, v string")
    q = spark.createDataFrame([(1, t) for t in range(5)], "node long, ts long")
    expected = {(1, 0, None), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b")}
    assert sets(tp.asof(q, h, "node", "ts", ["v"])) == expected
    assert sets(tp.asof_salted(q, h, "node", "ts", ["v"], 2)) == expected


def test_asof_of_hot_keys(spark):
    """Hot keys that are cut into ranges have the same rows as those of one window."""
    r = random.Random(3)
    keys = [None, 1, 1, 1, 1, 2, 3]
    h = [(r.choice(keys), r.randint(0, 60), i, r.choice([None, i])) for i in range(300)]
    q = [(i, r.choice(keys), r.randint(0, 70)) for i in range(200)] + [(200 + i, 4, 5) for i in range(50)]
    history = spark.createDataFrame(h, "node long, ts long, seen long, v long")
    queries = spark.createDataFrame(q, "id long, node long, ts long")
    want = set()
    for i, node, ts in q:
        best = max(((t, s, v) for k, t, s, v in h if k == node and t <= ts), default=(None, None, None), key=lambda x: x[:2])
        want.add((i, node, ts, *best[1:]))
    for hot_from, ranges in ((10**6, None), (40, 7), (40, 1), (1, 3)):
        assert sets(tp.asof(queries, history, "node", "ts", ["seen", "v"], "seen", hot_from=hot_from, ranges=ranges)) == want
    assert tp.asof(queries.limit(0), history, "node", "ts", ["v"], hot_from=40).count() == 0


def test_recent_neighbours_are_strictly_earlier(spark):
    e = spark.createDataFrame([(i, i % 3, i % 5, i // 4) for i in range(60)], "eid long, src long, dst long, ts long")
    got = tp.recent_k(e, 3).join(e.select(F.col("eid").alias("root_eid"), F.col("ts").alias("t")), "root_eid")
    assert got.where("dt <= 0 or rank > 3").count() == 0 and got.count() > 50


def test_mailbox_ring(spark):
    e = spark.createDataFrame([(0, i, 1, 9, i) for i in range(1, 4)], "batch long, eid long, src long, dst long, ts long")
    assert sets(st.mailbox(e, 2).where("node = 1").select("slot", "eid", "ts")) == {(0, 3, 3)}
    assert st.ring_position(e, 2).where("node = 1").first()["pos"] == 1


def test_mailbox_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i // 10, i, int(rng.integers(6)), int(rng.integers(6)), int(rng.integers(4)) + i // 10 * 4) for i in range(200)]
    e = spark.createDataFrame(rows, "batch long, eid long, src long, dst long, ts long")
    ring, pos = {}, {}
    for b in range(20):
        own = [r for r in rows if r[0] == b]
        for side in (2, 3):
            for node in {r[side] for r in own}:
                mine = sorted((r[4], r[1]) for r in own if r[side] == node)
                ring[node, pos.get(node, 0)] = mine[-1][1]
                pos[node] = (pos.get(node, 0) + len(mine)) % 3
    assert sets(st.mailbox(e, 3).select("node", "slot", "eid")) == {(n, s, i) for (n, s), i in ring.items()}
    assert sets(st.ring_position(e, 3)) == set(pos.items())


def test_mailbox_stream_equals_batch(spark, tmp_path):
    from chronoloom.streaming.state import mailbox_stream

    rows = [(i // 10, i, i % 4, (i * 3) % 5, i) for i in range(60)]
    e = spark.createDataFrame(rows, "batch long, eid long, src long, dst long, ts long")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = mailbox_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 3)
    q = stream.writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sets(spark.table("ring").select("node", "slot", "eid")) == sets(st.mailbox(e, 3).select("node", "slot", "eid"))


def test_windowed_stream_equals_batch(spark, tmp_path):
    from chronoloom.streaming.state import windowed_degrees

    e = spark.range(50).select((F.col("id") % 3).alias("src"), F.timestamp_seconds(F.col("id") * 40).alias("at"), F.lit(1.0).alias("weight"))
    e.write.parquet(str(tmp_path / "in"))
    s = windowed_degrees(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "10 minutes", "1 minute")
    q = s.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sets(spark.table("win").select("w.start", "src", "n")) == sets(windowed_degrees(e, "10 minutes", "1 minute").select("w.start", "src", "n"))


def test_chunk_decay_and_order():
    assert pt.chunk_decay("half", 4) == [2]
    assert pt.chunk_decay(3, 4) == [1, 2, 3]
    assert pt.chunk_decay([9, 2, 2], 4) == [2, 4]
    assert pt.chunk_decay("all", 3) == [1, 2, 3]
    assert pt.chunk_decay(None, 4) == pt.chunk_decay("none", 4) == []
    assert pt.chunk_decay(9, 4) == [1, 2, 3, 4] and pt.chunk_decay("half", 0) == pt.chunk_decay("other", 4) == []
    assert pt.chunk_order("none", 4) is None


def test_edge_prediction_metrics(spark):
    s = spark.createDataFrame([(0.5, 1), (0.7, 1), (0.2, 0), (0.3, 0)], "score double, label int")
    assert mt.auc(s).first()["auc_strict"] == 1.0
    assert round(mt.pseudo_ap(s).first()[0], 6) == 0.541593
    assert mt.average_precision(s).first()[0] == 1.0


def test_auc_and_ap_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(20)), int(rng.integers(2))) for _ in range(300)]
    s = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap = sum(sum(p == t for p in pos) * sum(p >= t for p in pos) / sum(x >= t for x, _ in rows) for t in set(pos)) / len(pos)
    assert mt.auc(s).first()["auc"] == pytest.approx(wins)
    assert mt.average_precision(s).first()[0] == pytest.approx(ap)


def test_regression_and_accuracy(spark):
    r = mt.regression(spark.createDataFrame([(1.1, 1.0), (2.1, 2.0)], "pred double, label double")).first()
    assert (round(r["mae"], 9), round(r["rmse"], 9)) == (0.1, 0.1)
    a = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 1)], "logits array<double>, label int")
    assert mt.accuracy(a).first()[0] == 1.0
    assert mt.cross_entropy(a).first()[0] == pytest.approx(math.log(1 + math.exp(-1)))


def test_norm_alpha_and_newer(spark):
    e = spark.createDataFrame([(0, 1, 2, 4.0)], "eid long, src long, dst long, weight double")
    assert pt.gcn_norm(e).first()["norm"] == 1.0
    assert st.adapted_alpha(0.5, 20, 10) == 0.51
    a = spark.createDataFrame([(1, 5, "a"), (2, 5, "a")], "node long, ts long, v string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 6, "b"), (3, 1, "b")], "node long, ts long, v string")
    assert sets(st.newer(a, b)) == {(1, 5, "a"), (2, 6, "b"), (3, 1, "b")}


def test_attention_sums_to_one(spark):
    e = spark.createDataFrame([(i, i % 7, i % 3, float(i)) for i in range(40)], "eid long, src long, dst long, weight double")
    sums = ms.edge_softmax(e, "weight").groupBy("dst").agg(F.sum("attention").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_recurrent_fold_against_numpy(spark):
    rng = np.random.default_rng(0)
    w = {"wi": rng.normal(size=(2, 9)), "wh": rng.normal(size=(3, 9)), "bi": rng.normal(size=9), "bh": rng.normal(size=9)}
    x = rng.normal(size=(4, 5, 2))
    f = spark.createDataFrame([(n, t, x[n, t].tolist()) for n in range(4) for t in range(5)], "node long, snap long, feat array<double>")
    got = {(r["node"], r["snap"]): r["state"] for r in ms.recurrent(f, w).collect()}
    h = np.zeros((4, 3))
    for t in range(5):
        h = ms.gru_cell(x[:, t], h, w)
        for n in range(4):
            assert got[n, t] == pytest.approx(h[n].tolist())


def test_partitions_cover_all_nodes(spark):
    e = edges.ring_events(spark, 20)
    parts = pt.label_propagation(e, 3)
    assert parts.count() == parts.select("node").distinct().count() == 40
    nodes, owners = pt.hot_aware(e, 3)
    assert owners.count() == e.count() and owners.select("eid").distinct().count() == e.count()


def test_largest_first(spark):
    loads = spark.createDataFrame([(0, 5.0), (1, 4.0), (2, 3.0), (3, 3.0)], "chunk_id long, load double")
    assert sp.largest_first(loads, 2) == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_index_packing(spark):
    df = spark.createDataFrame([(123456789012, 77, 1)], "a long, b int, c int")
    p = df.select(ev.pack_index(F.col("a"), F.col("b"), F.col("c")).alias("p"))
    assert tuple(p.select(*ev.unpack_index(F.col("p"))).first()) == (123456789012, 77, True)


def test_session_lifecycle(spark, tmp_path):
    root = str(tmp_path / "a")
    for mode in ("ctdg", "chunk", "dtdg"):
        s = Session.from_config(spark, {"mode": mode, "batch_size": 4}, edges.ring_events(spark, 8).withColumn("ts", F.col("ts").cast("long")), root)
        s.prepare_data()
        s.build_runtime()
        assert sum(b.count() for b in s.iter_batches("train")) == ev.split_sizes(32)[0]
        assert set(s.run("val").columns) >= {"auc", "ap", "bce"}
        assert s.predict().count() == ev.split_sizes(32)[2]
        s.config["epochs"] = 3
        log = s.run_task().orderBy("epoch", "split").collect()
        assert [(r["epoch"], r["split"]) for r in log] == [(e, x) for e in (1, 2, 3) for x in ("train", "val")]
        assert log[4]["bce"] <= log[0]["bce"] + 1e-6
        kept = dict(s.weights)
        s.save_checkpoint(str(tmp_path / f"cp-{mode}"))
        s.weights = {"scale": 0.0, "shift": 0.0}
        s.load_checkpoint(str(tmp_path / f"cp-{mode}"))
        assert s.weights == kept
        s.hooks["negatives"] = lambda e, pool: e.select("eid", "src", "dst", F.lit(0).cast("long").alias("neg"))
        s.hooks["neighbours"] = lambda roots, e: roots.limit(1)
        assert s.score("val").where("label = 0").count() == ev.split_sizes(32)[1] and s.neighbours("val").count() == 1
        s.config["max_batches"] = {"train": 2}
        assert sum(b.count() for b in s.iter_batches("train")) == 8
    with pytest.raises(artifacts.ArtifactError):
        Session.from_config(spark, {"mode": "ctdg", "parts": 2}, None, root).build_runtime()
    with pytest.raises(artifacts.ArtifactError):
        Session.from_config(spark, {"mode": "dtdg", "parts": 3}, None, root).build_runtime()
    with pytest.raises(ValueError):
        Session.from_config(spark, {"no_such_setting": 1})


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("src,dst,time,w\n1,2,3,0.5\n")
    (tmp_path / "e.edges").write_text("x y z\n1 2 3\n4 5 6\n")
    assert sets(edges.read_edges(spark, str(tmp_path / "e.csv"), "csv")) == {(1, 2, 3.0, 0.5)}
    assert sets(edges.read_edges(spark, str(tmp_path / "e.edges"), "lines", skiprows=1)) == {(1, 2, 3.0, 1.0), (4, 5, 6.0, 1.0)}
    (tmp_path / "n.csv").write_text("node,ts,a,name,b\n1,2,0.5,x,7\n")
    assert tuple(edges.read_node_features(spark, str(tmp_path / "n.csv")).select("node", "ts", "feat").first()) == (1, 2.0, [0.5, 7.0])
    with pytest.raises(ValueError):
        edges.read_edges(spark, "", "nothing")


def test_snapshots_of_eight_node_ring(spark):
    s = edges.ring_snapshots(spark, 3)
    assert sets(s.where("snap = 2").select("src", "dst")) == {(2, 3), (3, 4), (4, 5), (5, 6)}


def test_datasets_by_preset(spark, tmp_path):
    from chronoloom.plans.datasets import load_dataset, preset

    assert preset("soc-bitcoin", 4)["window"] == 100 and preset("other", 4)["window"] == 4
    (tmp_path / "e.txt").write_text("x\ny\n" + "".join(f"{i % 5},{i % 7},1,{i}\n" for i in range(60)))
    data = load_dataset(spark, str(tmp_path / "e.txt"), "rec-amazon-ratings", 4)
    assert data.num_nodes == 7 and data.edges.count() > 59 and data.nodes.where("label < 0").count() == 0


def test_public_names():
    import chronoloom

    assert all(getattr(chronoloom, n) is not None for n in chronoloom.__all__)
    with pytest.raises(AttributeError):
        chronoloom.no_such_name  # noqa: B018


def test_scratch_tables_can_be_discarded(spark):
    from chronoloom import scratch

    old = scratch.materialise(spark.range(3))
    new = scratch.materialise(old.withColumn("x", F.lit(1)), replaces=old)
    assert new.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(old._chronoloom_path).count()
    assert scratch.discard_tables(spark) >= 2


def test_widths_and_labels(spark):
    from chronoloom.plans import tasks

    rows = spark.createDataFrame([(1, [1.0, 2.0], 3)], "node long, feat array<double>, y int")
    assert tasks.vector_width(rows) == 2 and tasks.labels_of(rows).first()["label"] == 3.0
    with pytest.raises(ValueError):
        tasks.labels_of(rows.drop("y"))
    with pytest.raises(ValueError):
        tasks.vector_width(rows.union(spark.createDataFrame([(2, [1.0], 3)], rows.schema)))


def test_tasks_by_name(spark):
    from chronoloom.plans import tasks

    s = spark.createDataFrame([(0, 0.5, 1), (1, -0.5, 0)], "eid long, score double, label int")
    found = tasks.task("temporal_link_prediction")
    assert found.metrics(s).first()["auc"] == 1.0 and found.loss(s).first()[0] > 0
    assert found.output(s).count() == 2
    assert tasks.model("tgn") is tasks.model("tgat")
    with pytest.raises(KeyError):
        tasks.task("none")


@pytest.mark.parametrize("small", [8_000_000, 0])
def test_vectors_are_summed_in_one_row_for_each_node(spark, monkeypatch, small):
    monkeypatch.setattr(ms, "SMALL_ENTRIES", small)
    edges_ = spark.createDataFrame([(s, 100 + (0 if s < 30 else s % 7), float(s)) for s in range(60)], "src long, dst long, norm double")
    held = {s: [float(s + i) for i in range(s % 4)] for s in range(50)} | {3: [1.0, None, 2.0]}
    feats = spark.createDataFrame([(50, None), *held.items()], "node long, feat array<double>")
    want = {}
    for s, d, n in ((r["src"], r["dst"], r["norm"]) for r in edges_.collect()):
        for i, x in enumerate(held.get(s, [])):
            own = want.setdefault(d, {})
            own[i] = own.get(i, 0.0) + (0.0 if x is None else n * x)
    # target 100 is summed in parts, the others by a shuffle of their edges
    found = ms.propagate_vectors(edges_, feats, hot_from=20)
    assert "explode" not in found._jdf.queryExecution().toString()
    assert {r["node"]: dict(enumerate(r["feat"])) for r in found.collect()} == want
    by_snap = ms.propagate_vectors(edges_.withColumn("snap", F.lit(1)), feats.withColumn("snap", F.lit(1)), by=["snap"], width=3)
    assert {r["node"]: dict(enumerate(r["feat"])) for r in by_snap.collect()} == want


@pytest.mark.parametrize("by", [[], ["snap"]])
def test_parts_of_many_vectors_are_sent_to_the_edges(spark, monkeypatch, by):
    held = {(s, t): [float(s + t + i) for i in range(s % 5)] for s in range(33) for t in range(2)} | {(3, 0): [1.0, None, 2.0]}
    drawn = random.Random(3)
    rows_ = [(drawn.randrange(36), 100 if n % 3 == 0 else None if n == 1 else 101 + n % 9, n % 2, float(n % 7)) for n in range(400)]
    edges_ = spark.createDataFrame(rows_, "src long, dst long, snap long, norm double")
    feats = spark.createDataFrame([(50, 0, None), *[(s, t, v) for (s, t), v in held.items()]], "node long, snap long, feat array<double>")
    feats = feats if by else feats.where("snap = 0").drop("snap")
    monkeypatch.setattr(ms, "ROW_ENTRIES", 1)
    monkeypatch.setattr(ms, "SMALL_ENTRIES", 3 * feats.count())  # two of four components at once
    want = {}
    for s, d, t, n in rows_:
        for i, x in enumerate(held.get((s, t if by else 0), [])):
            own = want.setdefault((t, d) if by else (d,), {})
            own[i] = own.get(i, 0.0) + (0.0 if x is None else n * x)
    # target 100 is summed in parts, the others in buckets
    assert len(ms.vector_parts(edges_, feats, by=by, hot_from=100)) == 2
    whole = ms.propagate_vectors(edges_, feats, by=by, hot_from=100).collect()
    assert {tuple(r[c] for c in [*by, "node"]): dict(enumerate(r["feat"])) for r in whole} == want
    entries = ms.propagate_entries(edges_, feats, by=by, hot_from=100).collect()
    assert {(*(r[c] for c in [*by, "node"]), r["i"]): r["x"] for r in entries} == {(*k, i): x for k, v in want.items() for i, x in v.items()}


def test_no_vector_is_shuffled_with_an_edge(spark, monkeypatch, tmp_path):
    from chronoloom.plans.graph_queries import QUERIES

    drawn, sc = random.Random(5), spark.sparkContext._jsc.sc()
    vectors = [(v, [drawn.random() for _ in range(64)]) for v in range(400)]
    lines = [(drawn.randrange(400), drawn.randrange(3000), float(drawn.randrange(1, 50))) for _ in range(9000)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(ms, "SMALL_ENTRIES", 20_000)  # of 25,600

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in map(executors().apply, range(executors().size())))

    executors = lambda: sc.statusStore().executorList(False)
    before = shuffled()
    assert QUERIES["message_pass_whole_vectors"](spark, str(tmp_path)).agg(F.count("*")).first()[0] == 64 * len({d for _, d, _ in lines})
    assert shuffled() - before < 64 * 8 * len(lines) / 8  # an eighth of the edges' vectors


def test_links_of_a_session_are_made_once_for_all_epochs(spark, tmp_path, ring):
    calls = []

    def negatives(own, pool):
        calls.append(1)
        return sp.negatives(own, pool, 7)

    s = Session.from_config(spark, {"epochs": 2, "batch_size": 2}, ring.drop("rn"), str(tmp_path), ratio=[0.5, 0.25, 0.25])
    s.prepare_data()
    s.build_runtime().hooks["negatives"] = negatives
    assert s.run_task().count() == 4 and len(calls) == 2  # one for each split
    s.hooks["negatives"] = lambda own, pool: negatives(own, pool)
    s.run("val")
    assert len(calls) == 3
