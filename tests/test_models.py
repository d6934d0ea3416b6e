"""Models inside a session: gradients by finite differences, training, state from split to
split, checkpoints, and the epochs against plain loops over batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import gradients as gr
from chronoloom.operators import learning, memory, sequences, temporal
from chronoloom.plans.session import Session
from chronoloom.sources import artifacts

RNG = np.random.default_rng(4)


def numeric(f, weights, name, eps=1e-6):
    out = np.zeros_like(weights[name])
    for at in np.ndindex(out.shape):
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += sign * eps
            out[at] += sign * f(moved) / (2 * eps)
    return out


def agrees(f, weights, g):
    for name in g:
        assert np.allclose(g[name], numeric(f, weights, name), atol=1e-6), name


@pytest.mark.parametrize("cell", ["gru", "lstm", "tgcn"])
def test_cells_follow_finite_differences(cell):
    n, a, d = 5, 6 if cell == "tgcn" else 3, 2
    if cell == "tgcn":
        w = {**{k: RNG.normal(size=(2 * d, d)) for k in "urc"}, **{f"b{k}": RNG.normal(size=d) for k in "urc"}}
    else:
        gates = 3 if cell == "gru" else 4
        w = {"wi": RNG.normal(size=(a, gates * d)), "wh": RNG.normal(size=(d, gates * d)), "bi": RNG.normal(size=gates * d), "bh": RNG.normal(size=gates * d)}
    w |= {"x": RNG.normal(size=(n, a)), "h": RNG.normal(size=(n, d)), "m": RNG.normal(size=(n, d))}
    target = RNG.normal(size=(n, 2 * d))

    def value(v):
        if cell == "lstm":
            (h, c), _ = gr.lstm(v["x"], v["h"], v["m"], v)
            return float((np.concatenate([h, c], axis=1) * target).sum())
        return float((getattr(gr, cell)(v["x"], v["h"], v)[0] * target[:, :d]).sum())

    g = gr.zeros({k: v for k, v in w.items() if k not in "xhm"})
    if cell == "lstm":
        _, kept = gr.lstm(w["x"], w["h"], w["m"], w)
        dx, dh, dc = gr.lstm_back(target[:, :d], target[:, d:], kept, w, g)
        g |= {"x": dx, "h": dh, "m": dc}
    else:
        _, kept = getattr(gr, cell)(w["x"], w["h"], w)
        dx, dh = getattr(gr, f"{cell}_back")(target[:, :d], kept, w, g)
        g |= {"x": dx, "h": dh}
    agrees(value, w, g)


def link_batch(s, counts):
    near = lambda c: [{"rank": i + 1, "nbr": i, "dt": float(RNG.uniform(0, 5)), "feat": RNG.normal(size=s.width).tolist()} for i in range(c)]
    rows = [{"eid": e, **{f"{n}_near": near(c) for n, c in zip(("src", "dst", "neg"), own, strict=True)}, "held": RNG.normal(size=(3 + sum(own), s.dim)).tolist()} for e, own in enumerate(counts)]
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("nbr", pa.int64()), ("dt", pa.float64()), ("feat", pa.list_(pa.float64()))]))
    return pa.RecordBatch.from_pylist(rows, pa.schema([("eid", pa.int64()), *((f"{n}_near", kind) for n in ("src", "dst", "neg")), ("held", pa.list_(pa.list_(pa.float64())))]))


def test_attention_and_link_predictor_follow_finite_differences():
    s = memory.Shape(dim=4, width=2, dim_time=3, heads=2)
    w = memory.initial_weights(s, 3)
    w = {k: v + RNG.normal(0, 0.3, v.shape) for k, v in w.items()}
    batch = link_batch(s, [(2, 3, 1), (0, 1, 0), (4, 0, 2)])
    _, _, loss, g = memory.link_pass(batch, w, s, True)
    assert loss > 0 and set(g) == {k for k in w if k.startswith(("attend", "predict"))}
    agrees(lambda v: memory.link_pass(batch, v, s, False)[2], w, g)


@pytest.mark.parametrize("model", ["tgcn", "mpnn_lstm", "evolvegcn"])
def test_sequences_follow_finite_differences_through_time(model):
    d, n, t = 2, 4, 3
    cell = sequences.cell_of(model, d)
    w = {k: v + RNG.normal(0, 0.3, v.shape) for k, v in sequences.initial_weights(model, d, 2, 5).items()}
    w["x"] = RNG.normal(size=(n, t, cell.inputs))
    label, state = RNG.normal(size=(n, t)), RNG.normal(size=(n, cell.state))
    _, _, _, g, dx = sequences.sequence_pass(w["x"], label, state, w, cell, True)
    agrees(lambda v: sequences.sequence_pass(v["x"], label, state, v, cell, False)[2], w, g | {"x": dx})


def test_the_first_convolution_follows_finite_differences(spark):
    edges = spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 1, 0.3), (0, 1, 3, 0.7), (1, 3, 1, 0.4), (1, 2, 3, 1.1), (0, 3, 3, 0.2)], "snap long, src long, dst long, norm double")
    features = spark.createDataFrame([(s, n, RNG.normal(size=2).tolist()) for s in (0, 1) for n in (1, 2, 3)], "snap long, node long, feat array<double>")
    labels = spark.createDataFrame([(s, n, float(RNG.normal())) for s in (0, 1) for n in (1, 2)], "snap long, node long, label double")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    w = {k: v + RNG.normal(0, 0.2, v.shape) for k, v in sequences.initial_weights("tgcn", 1, 2, 5).items()}

    class Kept(learning.Adam):
        def step(self, weights, g):
            self.g = g
            return weights

    kept = Kept()
    sequences.sequence_epoch(edges, features, labels, nodes, 0, 2, 2, None, w, "tgcn", kept)

    def loss(v):
        e = edges.toPandas()
        f = {(r["snap"], r["node"]): np.array(r["feat"]) for r in features.collect()}
        y = {(r["snap"], r["node"]): r["label"] for r in labels.collect()}

        def passed(x):
            out = {}
            for s, a, b, m in e.itertuples(index=False):
                if (s, a) in x:
                    out[s, b] = out.get((s, b), 0) + m * x[s, a]
            return out

        h = passed({k: np.maximum(x @ v["gcn.0"], 0) for k, x in passed(f).items()})
        x = np.stack([np.stack([h.get((s, n), np.zeros(len(v["gcn.1"]))) for s in (0, 1)]) for n in (1, 2, 3, 4)])
        label = np.array([[y.get((s, n), 0.0) for s in (0, 1)] for n in (1, 2, 3, 4)])
        cell = sequences.cell_of("tgcn", 1)
        return sequences.sequence_pass(x, label, np.zeros((4, 1)), v, cell, False)[2] / label.size

    found = loss
    cache = {}

    def value(v):
        key = gr.packed(v).tobytes()
        if key not in cache:
            cache[key] = found(v)
        return cache[key]

    features, labels, edges = features.cache(), labels.cache(), edges.cache()
    agrees(value, w, {"gcn.0": kept.g["gcn.0"], "out.b": kept.g["out.b"]})


def events(spark, n=240):
    i = F.col("id")
    return spark.range(n).select(i.alias("eid"), (i * i % 7).alias("src"), (100 + i * 5 % 11).alias("dst"), (i * 1_000_000_000).alias("ts"), (1.0 + i % 3).alias("weight"))


def session(spark, root, mode, model, **more):
    s = Session.from_config(spark, {"mode": mode, "model": model, "batch_size": 90, "dim": 4, "neighbours": [3], "snaps": 8, "window": 3, "rate": 0.05, **more}, events(spark), root)
    s.prepare_data()
    return s.build_runtime()


@pytest.mark.parametrize(("mode", "model"), [("ctdg", "tgn"), ("dtdg", "mpnn_lstm")])
def test_training_lowers_the_loss_and_resumes_to_the_same_weights(spark, tmp_path, mode, model):
    s = session(spark, str(tmp_path / "data"), mode, model)
    first = s.run_epoch("train")
    columns = {"split", "auc", "auc_strict", "ap", "bce"} if mode == "ctdg" else {"split", "mse", "mae", "rmse", "nmae"}
    assert set(first.columns) == columns
    start = np.mean(s.losses)
    s.save_checkpoint(str(tmp_path / "cp"))
    resumed = Session.from_config(spark, s.config, None, s.root).build_runtime()
    resumed.load_checkpoint(str(tmp_path / "cp"))
    assert resumed.optimiser.steps == s.optimiser.steps > 0
    for k, v in s.params.items():
        assert np.array_equal(resumed.params[k], v)
    # validation starts with the state that training ended with
    assert np.allclose(s.run("val").toPandas().to_numpy(float), resumed.run("val").toPandas().to_numpy(float))
    for one in (s, resumed):
        one.run_epoch("train")
    for k, v in s.params.items():
        assert np.allclose(resumed.params[k], v, atol=1e-12), k
    s.run_epoch("train")
    assert np.mean(s.losses) < start
    with pytest.raises(artifacts.ArtifactError):
        Session.from_config(spark, {**s.config, "model": "tgat" if mode == "ctdg" else "tgcn"}, None, s.root).build_runtime().load_checkpoint(str(tmp_path / "cp"))


def test_memory_epoch_equals_a_loop_over_batches(spark, tmp_path):
    s = session(spark, str(tmp_path), "ctdg", "tgn", ratio=[1.0, 0.0, 0.0])
    s._ready()
    shape, w = s.shape, s.params
    s.run("train")
    got = {(r["eid"], r["label"]): r["score"] for r in s.found.collect()}
    state = s.states["train"].table().collect()
    memory_of, mail_of, pos_of = {}, {}, {}
    zero = lambda: np.zeros((shape.slots, shape.message))
    rows = sorted(s._prepared("train").collect(), key=lambda r: r["eid"])
    for b in range(s.n_batches("train")):
        batch = [r for r in rows if r["batch"] == b]
        ends = sorted({x for r in batch for x in (r["src"], r["dst"])})
        old = {n: memory_of.get(n, np.zeros(shape.dim)) for n in ends}
        for n in ends:
            h = np.zeros((1, shape.dim))
            for k in range(shape.slots):
                h, _ = gr.gru(mail_of.get(n, zero())[None, k], h, gr.part(w, "mail"))
            memory_of[n] = gr.gru(h, old[n][None], gr.part(w, "cell"))[0][0]
        for own, peer in (("src", "dst"), ("dst", "src")):
            for n in ends:
                mine = [r for r in batch if r[own] == n]
                if mine:
                    box = mail_of.setdefault(n, zero())
                    box[pos_of.get(n, 0)] = np.r_[old[n], old[mine[-1][peer]], mine[-1]["feat"]]
                    pos_of[n] = (pos_of.get(n, 0) + len(mine)) % shape.slots
        for r in batch:
            out = []
            for end in ("src", "dst", "neg"):
                near = r[f"{end}_near"]
                x = np.array([[*memory_of.get(y["nbr"], np.zeros(shape.dim)), *y["feat"]] for y in near]).reshape(len(near), shape.dim + 1)
                own = memory_of.get(r[end], np.zeros(shape.dim))[None]
                out.append(gr.attention(own, x, np.array([y["dt"] for y in near]), np.array([len(near)]), gr.part(w, "attend"), shape.heads, shape.dim_time)[0])
                before = [e for e in rows if e["ts"] < r["ts"] and r[end] in (e["src"], e["dst"])]
                assert len(near) == min(shape.k, len(before))
            for label, end in ((1, out[1]), (0, out[2])):
                assert abs(got[r["eid"], label] - gr.link(out[0], end, gr.part(w, "predict"))[0][0]) < 1e-9
    assert len(got) == 2 * len(rows) and len(state) == len(memory_of)
    for r in state:
        assert np.allclose(r["memory"], memory_of[r["node"]]) and np.allclose(r["mail"], mail_of[r["node"]].ravel()) and r["pos"] == pos_of[r["node"]]


def test_state_merges_changes_and_keeps_copies(spark):
    state = memory.NodeState(spark, merge_after=3)
    row = lambda n, v: (n, [float(v)], float(v), [0.0], v)
    for i in range(5):
        from chronoloom.scratch import materialise

        state.add(materialise(spark.createDataFrame([row(0, i), row(i, i)], memory._STATE)))
    assert len(state.changes) == 2
    kept = state.copy()
    state.add(materialise(spark.createDataFrame([row(0, 9)], memory._STATE)))
    assert {r["node"]: r["pos"] for r in kept.table().collect()} == {0: 4, 1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["node"]: r["pos"] for r in state.of(spark.createDataFrame([(0,), (3,), (77,)], "node long"), True).collect()} == {0: 9, 3: 3}


def test_models_are_refused_where_they_do_not_fit(spark):
    with pytest.raises(ValueError, match="no model"):
        Session.from_config(spark, {"mode": "ctdg", "model": "tgcn"})
    with pytest.raises(ValueError, match="no model"):
        Session.from_config(spark, {"mode": "chunk", "model": "tgn"})


def test_adam_is_saved_and_loaded(spark):
    w = {"a": RNG.normal(size=(2, 3)), "b": RNG.normal(size=4)}
    one = learning.Adam(0.1)
    moved = one.step(w, {k: v * 2 for k, v in w.items()})
    back, two = learning.from_weight_table(learning.weight_table(spark, moved, one), 0.1)
    g = {k: np.cos(v) for k, v in w.items()}
    x, y = one.step(moved, g), two.step(back, g)
    assert all(np.array_equal(x[k], y[k]) for k in w)


def test_settings_come_from_a_file_and_the_command_line(spark, tmp_path, capsys):
    from chronoloom.__main__ import main, settings

    path = tmp_path / "session.json"
    path.write_text('{"mode": "dtdg", "model": "evolvegcn", "snaps": 4, "dim": 3, "window": 2, "epochs": 5}')
    assert settings(spark, str(path), epochs=1, mode=None) == {"mode": "dtdg", "model": "evolvegcn", "snaps": 4, "dim": 3, "window": 2, "epochs": 1}
    assert settings(spark, None, mode="ctdg") == {"mode": "ctdg"}
    events(spark, 60).drop("eid").coalesce(1).write.option("header", True).csv(str(tmp_path / "edges"))
    main(["--edges", str(tmp_path / "edges"), "--root", str(tmp_path / "root"), "--config", str(path), "--epochs", "1", "--checkpoint", str(tmp_path / "cp")])
    said = capsys.readouterr().out
    assert "'mode': 'dtdg'" in said and "nmae" in said and "pred" in said
    assert artifacts.read_meta(spark, str(tmp_path / "cp"))["model"] == "evolvegcn"


@pytest.mark.parametrize("cut", [{}, {"hot_from": 20, "ranges": 5}])
def test_latest_events_are_kept_in_one_pass(spark, cut):
    rng = np.random.default_rng(8)
    events = [(i, int(rng.integers(0, 3)) if i % 4 else 9, int(rng.integers(0, 6)), int(rng.integers(0, 40)), [float(i)]) for i in range(120)]
    asked = [(i, int(rng.integers(0, 3)), int(rng.choice([0, 1, 2, 5, 9])), int(rng.integers(0, 45))) for i in range(90)]
    got = temporal.recent_lists(spark.createDataFrame(asked, "eid long, side int, root long, root_ts long"), spark.createDataFrame(events, "eid long, src long, dst long, ts long, feat array<double>"), 4, **cut)
    # no event is repeated for a question: events and questions meet in one sorted shuffle, without a join
    assert cut or not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Generate", "Window"))
    found = {(r["eid"], r["side"]): [tuple(x) for x in r["near"]] for r in got.collect()}
    for eid, side, root, at in asked:
        before = sorted(((t, e, d, f) for e, s, d, t, f in events if s == root and t < at), reverse=True)[:4]
        assert found[eid, side] == [(d, at - t, f) for t, e, d, f in before]
    assert len(found) == len(asked)


def test_memory_sent_to_tasks_scores_as_memory_joined(spark, tmp_path, monkeypatch):
    def scores(limit):
        monkeypatch.setattr(memory, "SMALL_ENTRIES", limit)
        s = session(spark, str(tmp_path / str(limit)), "ctdg", "tgn")
        s.run_epoch("train")
        s.run("val")
        return {(r["eid"], r["label"]): r["score"] for r in s.found.collect()}, s.losses

    (sent, one), (joined, two) = scores(10**6), scores(0)
    assert sent.keys() == joined.keys() and np.allclose([sent[k] for k in sent], [joined[k] for k in sent], atol=1e-12) and np.allclose(one, two)


def test_preparing_reads_the_given_events_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    given = events(spark)
    n = given.count()
    s = Session.from_config(spark, {"mode": "dtdg", "model": "tgcn", "snaps": 4}, given.mapInArrow(seen, given.schema), str(tmp_path))
    s.prepare_data()
    assert read.value == n and s.build_runtime().tables["nodes"].count() > 0
