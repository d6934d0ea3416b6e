"""A session facade: prepare, read back, run and predict over event graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import metrics
from chronoloom.functions.gradients import Weights
from chronoloom.operators import events as ev
from chronoloom.operators import learning, memory, sequences
from chronoloom.operators import messages as ms
from chronoloom.operators import partitioning as pt
from chronoloom.operators import sampling as sp
from chronoloom.operators import snapshots as sn
from chronoloom.operators import state as st
from chronoloom.operators import temporal as tp
from chronoloom.plans.datasets import numbered_events
from chronoloom.scratch import discard, materialise
from chronoloom.sources import artifacts, edges

#: Settings that are read; others are refused rather than silently unused.
DEFAULTS: dict[str, Any] = {"mode": "ctdg", "snaps": 8, "parts": 2, "batch_size": 200, "world_size": 1, "neighbours": [10], "ratio": [0.7, 0.15, 0.15], "partitioner": "round_robin", "seed": 7, "chunk_steps": 8, "epochs": 1, "eval_interval": 1, "max_batches": {}}
#: Settings of a model: its name (none: the link feature of ``score``), sizes of memory or
#: hidden state, attention and mailbox, learning rate, snapshots that gradients reach through.
DEFAULTS |= {"model": None, "dim": 8, "heads": 2, "dim_time": 4, "slots": 3, "time_unit": 1e9, "rate": 0.01, "window": 4}
MEMORY_MODELS, SNAPSHOT_MODELS = ("tgn", "jodie", "dyrep", "tgat", "apan"), ("gcn", "tgcn", "mpnn_lstm", "evolvegcn")


@dataclass
class Session:
    """hooks: functions DataFrame -> DataFrame that take the place of an own step:
    ``negatives`` of (events, pool), ``neighbours`` of (roots, visible events)."""

    spark: SparkSession
    config: dict[str, Any]
    events: DataFrame | None = None
    root: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    hooks: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=dict)
    #: a link's logit is scale * (how lately the pair met) + shift
    weights: dict[str, float] = field(default_factory=lambda: {"scale": 1.0, "shift": 0.0})
    #: of a named model: its weights, the optimiser, and the state that each split ended with
    params: Weights | None = None
    optimiser: learning.Adam | None = None
    states: dict[str, Any] = field(default_factory=dict)
    losses: list[float] = field(default_factory=list)
    #: scores or predictions of the split that a named model ran over last
    found: DataFrame | None = None
    _links: dict[Any, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_config(cls, spark: SparkSession, config: dict[str, Any], events: DataFrame | None = None, root: str | None = None, **overrides) -> Session:
        merged = {**DEFAULTS, **config, **overrides}
        unknown = sorted(set(merged) - set(DEFAULTS))
        if unknown:
            raise ValueError(f"settings that nothing reads: {', '.join(unknown)}")
        if merged["mode"] not in ("ctdg", "dtdg", "chunk"):
            raise ValueError(f"unknown mode {merged['mode']}")
        known = {"ctdg": MEMORY_MODELS, "dtdg": SNAPSHOT_MODELS}.get(merged["mode"], ())
        if merged["model"] is not None and merged["model"] not in known:
            raise ValueError(f"mode {merged['mode']} has no model {merged['model']}; there are {', '.join(known) or 'none'}")
        return cls(spark, merged, events, root)

    def _parts(self, ids: DataFrame, graph: DataFrame) -> DataFrame:
        n = self.config["parts"]
        if self.config["partitioner"] == "label_propagation":
            return pt.label_propagation(graph, n)
        node = F.col("node")
        rule = pt.contiguous(node, max(1, ids.count()), n) if self.config["partitioner"] == "range" else pt.round_robin(node, n)
        return ids.select(F.col("id").alias("node")).withColumn("part", rule)

    def prepare_data(self) -> dict[str, Any]:
        """Dense ids, order, splits, owners and, by mode, snapshots or batches as tables."""
        c = self.config
        # what several tables are made from is written: the given events are read once
        given = materialise(self.events)
        ids = materialise(ev.node_ids(given))
        moved = materialise(ev.remap(given, ids), replaces=given)
        graph = materialise(ev.with_row_number(moved, "ts", "eid"), replaces=moved)
        total = graph.count()
        splits = ev.event_batches(ev.assign_splits(graph, c["ratio"], total), c["batch_size"], c["world_size"])
        parts = materialise(self._parts(ids, graph))
        written = [ids, parts, graph]
        owner = pt.edge_owner(splits, parts, "dst" if c["mode"] == "dtdg" else "src")
        tables = {"nodes": ids, "parts": parts, "events": splits.join(owner, "eid")}
        if c["mode"] == "dtdg":
            snaps = sn.equal_count(graph, c["snaps"], total)
            halos = materialise(pt.halo(graph, parts))
            index = materialise(pt.local_index(parts, halos))
            written += [halos, index]
            tables |= {"snapshots": pt.gcn_norm(snaps, ["snap"]), "blocks": pt.snapshot_blocks(snaps, parts, index), "degrees": sn.degrees(snaps), "halo": halos, "index": index, "routes": pt.send_index(halos, index), "manifest": pt.manifest(graph, parts)}
        if c["mode"] == "ctdg":
            tables |= {"boundaries": splits.groupBy("split", "batch").agg(F.min("eid").alias("first"), F.max("eid").alias("last"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.count("*").alias("n"))}
        if c["mode"] == "chunk":
            clusters = parts.withColumnRenamed("part", "cluster")
            chunked = sp.chunks(sn.equal_count(graph, c["snaps"], total), F.col("snap"), clusters)
            table = sp.chunk_table(chunked)
            tables |= {"chunk_edges": chunked, "chunks": table, "chunk_deps": sp.temporal_deps(table, c["chunk_steps"]), "chunk_remote": sp.remote_nodes(chunked)}
        for name, df in tables.items():
            artifacts.write_table(df, f"{self.root}/{name}", ["part"] if name == "events" else ["snap"] if name == "snapshots" else None)
        discard(*written)
        artifacts.write_meta(self.spark, self.root, {"mode": c["mode"], "parts": c["parts"], "snaps": c["snaps"], "sizes": dict(zip(ev.SPLITS, ev.split_sizes(total, c["ratio"]), strict=True)), "tables": sorted(tables)})
        return artifacts.read_meta(self.spark, self.root)

    def build_runtime(self) -> Session:
        """The prepared tables, after a check that they fit this session."""
        c = self.config
        meta = artifacts.validated(self.spark, self.root, c["mode"], c["parts"], ("routes",) if c["mode"] == "dtdg" else ("events",))
        self.tables = {t: artifacts.read_artifact(self.spark, self.root, t) for t in meta["tables"]}
        self.sizes = meta["sizes"]
        self._links = {}
        return self

    def n_batches(self, split: str) -> int:
        """From the prepared sizes: no job is run for it."""
        n = -(-self.sizes[split] // (self.config["batch_size"] * self.config["world_size"]))
        return min(n, self.config["max_batches"].get(split, n))

    def iter_batches(self, split: str):
        """Batches of a split, one DataFrame each."""
        rows = self.tables["events"].where(F.col("split") == split)
        for i in range(self.n_batches(split)):
            yield rows.where(F.col("batch") == i)

    def neighbours(self, split: str) -> DataFrame:
        """Neighbours of a split's batch roots among the events that the split may see."""
        rows = self.tables["events"]
        roots = tp.batch_roots(rows.where(F.col("split") == split)).select("root", "root_ts").distinct()
        find = self.hooks.get("neighbours", lambda r, e: tp.recent_k_of(r, e, self.config["neighbours"][0]))
        return find(roots, ev.visible_to(rows, split))

    def _met(self, split: str) -> DataFrame:
        """(eid, met, label) of a split's events and a negative for each, written once: it
        does not depend on the weights."""
        own = (split, self.config["seed"], str(self.config["max_batches"]), self.hooks.get("negatives"))
        if own not in self._links:
            rows = self.tables["events"]
            mine = ev.capped(rows.where(F.col("split") == split), self.config["max_batches"])
            neg = self.hooks.get("negatives", lambda e, pool: sp.negatives(e, pool, self.config["seed"]))(mine, sp.pool(rows))
            both = mine.select("eid", "src", "dst", "ts", F.lit(1).alias("label")).unionByName(neg.join(mine.select("eid", "ts"), "eid").select("eid", "src", F.col("neg").alias("dst"), "ts", F.lit(0).alias("label")))
            pair = F.struct("src", "dst")
            asked = both.select("*", pair.alias("pair"))
            met = rows.select(pair.alias("pair"), F.col("ts"), F.col("eid").alias("seen"))
            found = tp.asof(asked.withColumn("ts", F.col("ts") - 1), met, "pair", "ts", ["seen"], "seen")
            self._links[own] = materialise(found.select("eid", F.when(F.col("seen").isNull(), -1.0).otherwise(1.0 / (1 + F.col("eid") - F.col("seen"))).alias("met"), "label"))
        return self._links[own]

    def score(self, split: str) -> DataFrame:
        """(eid, met, score, label) of a split's events and a negative for each: how lately
        the source met the target before, and the logit that follows."""
        return self._met(split).select("eid", "met", (F.lit(self.weights["scale"]) * F.col("met") + F.lit(self.weights["shift"])).alias("score"), "label")

    @staticmethod
    def _link_metrics(scores: DataFrame) -> DataFrame:
        sums = materialise(metrics.by_score(scores))
        return metrics.auc(sums).crossJoin(metrics.average_precision(sums)).crossJoin(metrics.bce(scores))

    # a named model

    @property
    def shape(self) -> memory.Shape:
        c = self.config
        return memory.Shape(c["dim"], 1, c["dim_time"], c["heads"], c["slots"], c["neighbours"][0], c["time_unit"], c["model"] != "tgat")

    def _ready(self) -> None:
        """Weights by the seed, unless they are set or loaded already."""
        c = self.config
        if self.params is None:
            self.params = memory.initial_weights(self.shape, c["seed"]) if c["mode"] == "ctdg" else sequences.initial_weights(c["model"], c["dim"], 2, c["seed"])
        if self.optimiser is None:
            self.optimiser = learning.Adam(c["rate"])

    def _prepared(self, split: str) -> DataFrame:
        """A split's events with negatives and neighbours, written once."""
        if split not in self._links:
            rows = self.tables["events"].withColumn("feat", F.array(F.col("weight")))
            mine = ev.capped(rows.where(F.col("split") == split), self.config["max_batches"])
            neg = self.hooks.get("negatives", lambda e, pool: sp.negatives(e, pool, self.config["seed"]))(mine, sp.pool(rows))
            self._links[split] = memory.prepared_links(mine.select("eid", "src", "dst", "ts", "feat", "batch"), ev.visible_to(rows, split), neg, self.shape)
        return self._links[split]

    def _model_epoch(self, split: str, train: bool) -> DataFrame:
        """Scores or predictions of a split by the model. State goes on from the split
        before, which is run through as it is where that has not been done; a later split's
        state does not outlive a change of an earlier one's."""
        self._ready()
        at = ev.SPLITS.index(split)
        before = None
        if at:
            if ev.SPLITS[at - 1] not in self.states:
                self._model_epoch(ev.SPLITS[at - 1], False)
            before = self.states[ev.SPLITS[at - 1]]
        optimiser = self.optimiser if train else None
        if self.config["mode"] == "ctdg":
            state = before.copy() if before is not None else memory.NodeState(self.spark)
            found, params, losses = memory.memory_epoch(self._prepared(split), state, self.params, self.shape, self.n_batches(split), optimiser)
        else:
            found, state, params, losses = self._sequence(split, before, optimiser)
        self.params, self.losses = params, losses if train else self.losses
        self.states = {k: v for k, v in self.states.items() if ev.SPLITS.index(k) < at} | {split: state}
        self.found = found
        return found

    def snapshot_span(self, split: str) -> tuple[int, int]:
        """First snapshot of a split and the one behind its last."""
        a, b, _ = ev.split_sizes(self.config["snaps"], self.config["ratio"])
        return {"train": (0, a), "val": (a, a + b), "test": (a + b, self.config["snaps"])}[split]

    def _sequence(self, split: str, before, optimiser):
        c, t = self.config, self.tables
        if "messages" not in self._links:
            feats = t["degrees"].select("snap", "node", F.array(F.log1p("in_deg"), F.log1p("out_deg")).alias("feat"))
            self._links["messages"] = materialise(ms.propagate_vectors(t["snapshots"], feats, by=["snap"], width=2))
            self._links["features"] = materialise(feats)
        nodes = t["nodes"].select(F.col("id").alias("node"))
        return sequences.sequence_epoch(t["snapshots"], self._links["features"], t["degrees"], nodes, *self.snapshot_span(split), c["window"], before, self.params, c["model"], optimiser, self._links["messages"])

    def _model_metrics(self, found: DataFrame) -> DataFrame:
        if self.config["mode"] == "dtdg":
            return metrics.mse(found).crossJoin(metrics.regression(found))
        return self._link_metrics(found)

    def run_epoch(self, split: str) -> DataFrame:
        """Metrics of a split, with its name. A named model takes a step for each batch or
        window of the training split, and only runs over the others; without one, a Newton
        step of the link weights comes first, from sums over all training events."""
        if self.config["model"]:
            return self._model_metrics(self._model_epoch(split, split == "train")).withColumn("split", F.lit(split))
        scores = self.score(split)
        if split == "train":
            p = metrics.sigmoid(F.col("score"))
            g, h, x = F.col("label") - p, p * (1 - p), F.col("met")
            r = scores.agg(F.sum(g).alias("g0"), F.sum(g * x).alias("g1"), F.sum(h).alias("h0"), F.sum(h * x).alias("h1"), F.sum(h * x * x).alias("h2")).first()
            if r["g0"] is not None:
                shift, scale = np.linalg.solve(np.array([[r["h0"] + 1, r["h1"]], [r["h1"], r["h2"] + 1]]), np.array([r["g0"] - self.weights["shift"], r["g1"] - self.weights["scale"]]))
                self.weights = {"scale": self.weights["scale"] + float(scale), "shift": self.weights["shift"] + float(shift)}
                scores = scores.withColumn("score", F.lit(self.weights["scale"]) * x + F.lit(self.weights["shift"]))
        return self._link_metrics(scores).withColumn("split", F.lit(split))

    def run(self, split: str) -> DataFrame:
        """Metrics of a split with the weights as they are."""
        if self.config["model"]:
            return self._model_metrics(self._model_epoch(split, False))
        return self._link_metrics(self.score(split))

    evaluate = run

    def run_task(self) -> DataFrame:
        """A row of metrics for each epoch and split: the epochs of training, with the
        validation split after every ``eval_interval`` of them. Links have auc, auc_strict,
        ap and bce; snapshot models mse, mae, rmse and nmae."""
        out = None
        for epoch in range(1, self.config["epochs"] + 1):
            splits = ["train", "val"] if epoch % self.config["eval_interval"] == 0 else ["train"]
            for split in splits:
                row = self.run_epoch(split).withColumn("epoch", F.lit(epoch))
                out = row if out is None else out.unionByName(row)
        return out

    def predict(self, split: str = "test") -> DataFrame:
        """(eid, score, label) of links, (node, snap, pred, label) of snapshot models."""
        if self.config["model"]:
            found = self._model_epoch(split, False)
            return found if self.config["mode"] == "dtdg" else found.where("label = 1").select("eid", "score", "label")
        return self.score(split).where("label = 1").select("eid", "score", "label")

    def save_checkpoint(self, path: str) -> None:
        """The weights, and in mode ctdg the mailbox after all prepared events; of a named
        model its weights, the optimiser and the state that each split ended with."""
        if self.config["model"]:
            self._ready()
            tables = {"weights": learning.weight_table(self.spark, self.params, self.optimiser)}
            for split, state in self.states.items():
                if isinstance(state, np.ndarray):
                    tables[f"state_{split}"] = learning.weight_table(self.spark, {"matrix": state})
                elif state is not None:
                    tables[f"state_{split}"] = state.table() if isinstance(state, memory.NodeState) else state
            artifacts.save_checkpoint(path, **tables)
            artifacts.write_meta(self.spark, path, {"model": self.config["model"], "states": sorted(k for k in tables if k != "weights")})
            return
        tables = {"weights": self.spark.createDataFrame(sorted(self.weights.items()), "name string, value double").coalesce(1)}
        if self.config["mode"] == "ctdg" and self.tables:
            order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
            width = max(1, *(self.n_batches(s) for s in ev.SPLITS))
            tables["mailbox"] = st.mailbox(self.tables["events"].withColumn("batch", order * width + F.col("batch")), 1)
        artifacts.save_checkpoint(path, **tables)

    def load_checkpoint(self, path: str) -> dict[str, DataFrame]:
        if self.config["model"]:
            meta = artifacts.validated(self.spark, path)
            if meta["model"] != self.config["model"]:
                raise artifacts.ArtifactError(f"saved for model {meta['model']}, not {self.config['model']}")
            found = artifacts.load_checkpoint(self.spark, path, "weights", *meta["states"])
            self.params, self.optimiser = learning.from_weight_table(found["weights"], self.config["rate"])
            self.states = {}
            for name in meta["states"]:
                table = found[name]
                if self.config["model"] == "evolvegcn":
                    self.states[name[6:]] = learning.from_weight_table(table)[0]["matrix"]
                else:  # a copy, as the run may replace its tables
                    self.states[name[6:]] = memory.NodeState(self.spark, materialise(table)) if self.config["mode"] == "ctdg" else materialise(table)
            return found
        names = ["weights", "mailbox"] if self.config["mode"] == "ctdg" and self.tables else ["weights"]
        found = artifacts.load_checkpoint(self.spark, path, *names)
        self.weights = {r["name"]: r["value"] for r in found["weights"].collect()}
        return found


def load_edges(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Events of a file, numbered in their order of time."""
    return numbered_events(edges.read_edges(spark, path, kind))
