"""Epochs of named models as registered queries, with their SQL: every batch or window of
the loop is a step of its own in the statement."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import gradients as gr
from chronoloom.operators import memory, sequences
from chronoloom.operators.events import split_sizes
from chronoloom.plans.session import Session

SHAPE = memory.Shape(dim=4, width=1, dim_time=4, heads=2, slots=3, k=5)
TGN = memory.initial_weights(SHAPE, 7)
#: A batch is a quarter of all events: three of them train, one validates, one tests.
STEPS = [("train", 0), ("train", 1), ("train", 2), ("val", 0), ("test", 0)]


def memory_epoch_sql(fragments: dict[str, str], tools: dict[str, Callable]) -> str:
    """Scores of all events and their negatives; state goes on from step to step."""
    linear, gru, lst, each = (tools[k] for k in ("linear", "gru", "list", "each"))
    s, w = SHAPE, TGN
    mail, cell, attend, predict = (gr.part(w, k) for k in ("mail", "cell", "attend", "predict"))
    zero, empty = lst([0] * s.dim), lst([0] * s.message)
    encoded = lambda dt: f"list_transform(range({s.dim_time}), lambda t: cos({dt} * pow(10.0, -9.0 * t / {s.dim_time - 1})))"
    out = [
        fragments["split"],
        fragments["ids"],
        "wh AS (SELECT sp.eid, a.id AS src, b.id AS dst, ts, weight, split, (rn_in_split // greatest(1, (SELECT n // 4 FROM tot)))::BIGINT AS batch FROM sp JOIN ids a ON a.node = src JOIN ids b ON b.node = dst)",
        "po AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT dst AS node FROM wh))",
        "np AS (SELECT count(*) AS n FROM po)",
        "dr AS (SELECT eid, dst, ((eid * 48271 + 7) % 2147483647) % n AS i, n FROM wh, np)",
        "mv AS (SELECT eid, CASE WHEN po.node = dr.dst THEN (dr.i + 1) % n ELSE dr.i END AS j FROM dr JOIN po ON po.i = dr.i)",
        "e AS MATERIALIZED (SELECT wh.*, po.node AS neg FROM wh JOIN mv USING (eid) JOIN po ON po.i = mv.j)",
        "bo AS (SELECT eid, src, dst, ts, weight, split FROM e UNION ALL SELECT eid, dst, src, ts, weight, split FROM e)",
        "ro AS (SELECT DISTINCT split, batch, root, ts FROM (SELECT split, batch, ts, unnest([src, dst, neg]) AS root FROM e))",
        f"""nb AS MATERIALIZED (SELECT * FROM (SELECT ro.split, ro.batch, root, ro.ts, bo.dst AS nbr, bo.weight, (ro.ts - bo.ts)::DOUBLE / 1e9 AS dt, row_number() OVER (PARTITION BY ro.split, ro.batch, root, ro.ts ORDER BY bo.ts DESC, bo.eid DESC) AS rank
            FROM ro JOIN bo ON bo.src = root AND bo.ts < ro.ts AND (ro.split = 'test' OR bo.split = 'train' OR bo.split = ro.split)) WHERE rank <= {s.k})""",
    ]
    state = None
    for t, (split, batch) in enumerate(STEPS):
        here = f"split = '{split}' AND batch = {batch}"
        old = state or "(SELECT NULL::BIGINT AS node, NULL::DOUBLE[] AS memory, NULL::DOUBLE[][] AS mail, NULL::BIGINT AS pos WHERE FALSE)"
        out += [
            f"c{t} AS (SELECT node, side, count(*) AS n, max({{'ts': ts, 'eid': eid, 'peer': peer, 'w': weight}}) AS m FROM (SELECT eid, ts, weight, src AS node, dst AS peer, 0 AS side FROM e WHERE {here} UNION ALL SELECT eid, ts, weight, dst, src, 1 FROM e WHERE {here}) GROUP BY ALL)",
            f"m{t} AS (SELECT c.node, side, n, list_concat(list_concat(coalesce(a.memory, {zero}), coalesce(b.memory, {zero})), [c.m.w]) AS v FROM c{t} c LEFT JOIN {old} a ON a.node = c.node LEFT JOIN {old} b ON b.node = c.m.peer)",
            f"""h{t} AS (SELECT p.*, coalesce(o.memory, {zero}) AS memory, coalesce(o.mail, [{', '.join([empty] * s.slots)}]) AS mail, coalesce(o.pos, 0) AS pos FROM (SELECT node, coalesce(max(n) FILTER (side = 0), 0) AS n0, coalesce(max(n) FILTER (side = 1), 0) AS n1, max(v) FILTER (side = 0) AS v0, max(v) FILTER (side = 1) AS v1 FROM m{t} GROUP BY node) p LEFT JOIN {old} o ON o.node = p.node)""",
        ]
        rows, hidden = f"SELECT * FROM h{t}", zero
        for k in range(s.slots):
            for level in gru(f"mail[{k + 1}]", hidden, mail, s.dim, f"g{k}"):
                rows = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in level.items())} FROM ({rows})"
            hidden = f"g{k}"
        for level in gru(hidden, "memory", cell, s.dim, "new"):
            rows = f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in level.items())} FROM ({rows})"
        first = f"CASE WHEN n0 > 0 AND i - 1 = pos THEN v0 ELSE mail[i] END"
        ring = f"list_transform(range(1, {s.slots + 1}), lambda i: CASE WHEN n1 > 0 AND i - 1 = (pos + n0) % {s.slots} THEN v1 ELSE {first} END)"
        out.append(f"u{t} AS (SELECT node, new AS memory, {ring} AS mail, (pos + n0 + n1) % {s.slots} AS pos FROM ({rows}))")
        out.append(f"s{t} AS MATERIALIZED (SELECT * FROM u{t} UNION ALL SELECT * FROM {old} o WHERE node NOT IN (SELECT node FROM u{t}))")
        state = f"s{t}"
        own = f"coalesce(a.memory, {zero})"
        d = s.dim // s.heads
        out += [
            f"""k{t} AS (SELECT nb.root, nb.ts, rank, {linear(f"list_concat({own}, {encoded('0.0')})", attend['q'], attend['bq'])} AS q, list_concat(list_concat(coalesce(b.memory, {zero}), [nb.weight]), {encoded('nb.dt')}) AS key FROM nb LEFT JOIN s{t} a ON a.node = nb.root LEFT JOIN s{t} b ON b.node = nb.nbr WHERE {here})""",
            f"v{t} AS (SELECT root, ts, q, {linear('key', attend['k'], attend['bk'])} AS k, {linear('key', attend['v'], attend['bv'])} AS v FROM k{t})",
            f"x{t} AS (SELECT root, ts, v, h, exp(z - max(z) OVER (PARTITION BY root, ts, h)) AS z FROM (SELECT root, ts, v, h, CASE WHEN z < 0 THEN 0.2 * z ELSE z END AS z FROM (SELECT root, ts, v, h, {' + '.join(f'q[{d} * h + {j}] * k[{d} * h + {j}]' for j in range(1, d + 1))} AS z FROM v{t}, (SELECT unnest(range({s.heads})) AS h))))",
            f"a{t} AS (SELECT root, ts, list(x ORDER BY i) AS agg FROM (SELECT root, ts, {d} * h + j AS i, sum(z * v[{d} * h + j]) / sum(z) AS x FROM x{t}, (SELECT unnest(range(1, {d + 1})) AS j) GROUP BY ALL) GROUP BY ALL)",
            f"""y{t} AS (SELECT root, ts, y, list_avg(y) AS mean FROM (SELECT ro.root, ro.ts, list_transform({linear(f"list_concat(coalesce(agg, {zero}), {own})", attend['out'], attend['bout'])}, lambda t: greatest(t, 0.0)) AS y FROM (SELECT * FROM ro WHERE {here}) ro LEFT JOIN a{t} g ON g.root = ro.root AND g.ts = ro.ts LEFT JOIN s{t} a ON a.node = ro.root))""",
            f"z{t} AS MATERIALIZED (SELECT root, ts, {each(s.dim, '(y[i] - mean) / sqrt(list_avg(list_transform(y, lambda t: (t - mean) * (t - mean))) + 1e-5)')} AS x FROM y{t})",
            f"""l{t} AS (SELECT e.eid, '{split}' AS split, e.batch, label, {linear('p.x', predict['src'], predict['bsrc'])} AS s, {linear('r.x', predict['dst'], predict['bdst'])} AS d FROM (SELECT eid, split, batch, src, ts, unnest([{{'node': dst, 'label': 1}}, {{'node': neg, 'label': 0}}], recursive := true) FROM e WHERE {here}) e JOIN z{t} p ON p.root = e.src AND p.ts = e.ts JOIN z{t} r ON r.root = e.node AND r.ts = e.ts)""",
        ]
    score = f"({linear(each(s.dim, 'greatest(s[i] + d[i], 0.0)'), predict['out'], predict['bout'])})[1]"
    found = " UNION ALL ".join(f"SELECT eid, split, batch, label, round({score}, 5) AS score FROM l{t}" for t in range(len(STEPS)))
    return "WITH " + ",\n".join(out) + "\n" + found


def memory_epoch(session: Session) -> DataFrame:
    """All three splits run through by a memory model, state handed from one to the next."""
    session.params = dict(TGN)
    out = None
    for split in ("train", "val", "test"):
        session.run(split)
        found = session.found.select("eid", F.lit(split).alias("split"), "batch", F.col("label").cast("int").alias("label"), F.round("score", 5).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def sequence_weights(tgcn: dict) -> dict:
    cell = {k: v for k, v in tgcn.items() if k != "gcn"}
    d = tgcn["u"].shape[1]
    out = {"w": np.random.default_rng(60).normal(0, 0.5, (d, 1)), "b": np.array([0.25])}
    return gr.flattened({"gcn": tgcn["gcn"], "cell": cell, "out": out})


def snapshot_epoch_sql(states: str, weights: dict, snaps: int, features: str) -> str:
    """Metrics of each split from the states of all snapshots (st), as a linear readout."""
    a, b, _ = split_sizes(snaps)
    w = weights["out.w"][:, 0]
    pred = " + ".join([f"h[{i + 1}] * {float(v)!r}" for i, v in enumerate(w)] + [repr(float(weights["out.b"][0]))])
    return f"""WITH RECURSIVE {features}, {states},
        pr AS (SELECT CASE WHEN st.snap < {a} THEN 'train' WHEN st.snap < {a + b} THEN 'val' ELSE 'test' END AS split, {pred} AS p, coalesce(ln(1 + in_deg), 0.0) AS y FROM st LEFT JOIN deg ON deg.node = st.node AND deg.snap = st.snap)
        SELECT split, round(avg((p - y) * (p - y)), 5) AS mse, round(avg(abs(p - y)), 5) AS mae, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, round(avg(abs(p - y)) / abs(avg(y)), 5) AS nmae, count(*) AS n FROM pr GROUP BY split"""


def snapshot_epoch(session: Session, weights: dict) -> DataFrame:
    """Metrics of all three splits run through by a snapshot model in windows of three."""
    session.params = dict(weights)
    out = None
    for split in ("train", "val", "test"):
        row = session.run(split).withColumn("split", F.lit(split)).crossJoin(session.found.agg(F.count("*").alias("n")))
        out = row if out is None else out.unionByName(row)
    return out.select("split", *[F.round(c, 5).alias(c) for c in ("mse", "mae", "rmse", "nmae")], "n")


def streaming_cut_sql(events: str, parts: int, batches: int, decay: float, mixed: Callable[[str], str]) -> str:
    """The part of each edge; copies, degrees and loads go on from batch to batch."""
    out = [events, f"si AS (SELECT greatest(1, (count(*) + {batches - 1}) // {batches})::BIGINT AS per FROM ev)"]
    state, placed = None, []
    for t in range(batches):
        old = state or "(SELECT NULL::BIGINT AS node, NULL::INTEGER[] AS parts, NULL::DOUBLE AS degree, NULL::DOUBLE AS seen WHERE FALSE)"
        before = " UNION ALL ".join(f"SELECT part FROM p{i}" for i in placed) or "SELECT NULL::INTEGER AS part WHERE FALSE"
        loads = ", ".join(f"(SELECT count(*) FROM ({before}) WHERE part = {p}) AS l{p}" for p in range(parts))
        ls = ", ".join(f"l{p}" for p in range(parts))
        copy = lambda end, p, own: f"CASE WHEN list_contains({end}_parts, {p}) THEN 2.0 - ({own}) ELSE 0.0 END"
        score = lambda p: f"round({copy('src', p, 'share')} + {copy('dst', p, '1.0 - share')} + (greatest({ls}) - l{p})::DOUBLE / (1.0 + greatest({ls}) - least({ls})), 9)"  # noqa: B023, E731
        best = f"-(list_reverse_sort([{', '.join(f'[{score(p)}, {-p}.0::DOUBLE]' for p in range(parts))}])[1][2])::INTEGER"
        out += [
            f"r{t} AS (SELECT eid, src, dst, ts FROM ev, si WHERE rn >= {t} * per AND rn < {t + 1} * per)",
            f"n{t} AS (SELECT max(ts)::DOUBLE AS now FROM r{t})",
            f"k{t} AS MATERIALIZED (SELECT e.node, coalesce(parts, []) AS parts, round(coalesce(degree * exp(-{decay!r} * (now - seen)), 0.0) + n, 9) AS degree FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM r{t} UNION ALL SELECT dst FROM r{t}) GROUP BY node) e LEFT JOIN {old} s ON s.node = e.node, n{t})",
            f"b{t} AS (SELECT eid, src, dst, a.parts AS src_parts, b.parts AS dst_parts, a.degree AS da, b.degree AS db, a.degree / (a.degree + b.degree) AS share FROM r{t} JOIN k{t} a ON a.node = src JOIN k{t} b ON b.node = dst)",
            f"o{t} AS (SELECT {loads})",
            f"p{t} AS MATERIALIZED (SELECT eid, src, dst, CASE WHEN len(src_parts) = 0 AND len(dst_parts) = 0 THEN (({mixed('CASE WHEN da <= db THEN src ELSE dst END')}) % {parts})::INTEGER ELSE {best} END AS part FROM b{t}, o{t})",
            f"s{t} AS MATERIALIZED (SELECT k.node, list_sort(list_distinct(list_concat(k.parts, m.more))) AS parts, degree, now AS seen FROM k{t} k JOIN (SELECT node, list(DISTINCT part) AS more FROM (SELECT src AS node, part FROM p{t} UNION ALL SELECT dst, part FROM p{t}) GROUP BY node) m ON m.node = k.node, n{t} UNION ALL SELECT * FROM {old} o WHERE node NOT IN (SELECT node FROM k{t}))",
        ]
        placed.append(t)
        state = f"s{t}"
    return "WITH " + ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT eid, part FROM p{t}" for t in placed)
