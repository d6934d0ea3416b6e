"""Snapshot datasets of an edge list, by preset or by settings of one's own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import events as ev
from chronoloom.operators import snapshots as sn
from chronoloom.scratch import materialise
from chronoloom.sources.edges import PRESETS, read_edge_csv, read_edge_lines


@dataclass
class SnapshotDataset:
    """Edges with their snapshot, node features and labels of each, and counts."""

    edges: DataFrame
    nodes: DataFrame
    num_nodes: int
    num_snapshots: int


def numbered_events(rows: DataFrame) -> DataFrame:
    """Events with ``eid``, their number in order of time, then of all other columns."""
    rest = [c for c in rows.columns if c != "ts" and not c.startswith("_")]
    return ev.with_row_number(rows, "ts", *rest, name="eid")


def preset(name: str, snaps: int) -> dict:
    """A preset's settings; windows leave room for the lags."""
    found = {"window": max(1, snaps), "lags": 0, "skiptime": 0, "skiprows": 0, **PRESETS.get(name, {})}
    if not found.get("use_batch_split"):
        found["window"] = max(found["window"], snaps + found["lags"])
    return found


def snapshot_dataset(edges: DataFrame, window: int, lags: int = 0, skiptime: int = 0, batch_size: int | None = None, use_batch_split: bool = False, **_) -> SnapshotDataset:
    """Dense ids, then fixed batches or sliding windows, with degrees and labels."""
    ids = ev.node_ids(edges)
    graph = materialise(ev.remap(edges, ids))
    if use_batch_split:
        snaps = sn.fixed_batches(ev.with_row_number(ev.after_skiptime(graph, skiptime), "ts", "eid"), batch_size or 1)
    else:
        snaps = sn.masked_windows(graph, window, lags, skiptime)
    snaps = materialise(snaps)
    count = (snaps.agg(F.max("snap")).first()[0] or 0) + 1 if not snaps.isEmpty() else 0
    return SnapshotDataset(snaps, sn.degrees(snaps), ids.count(), count)


def load_dataset(spark: SparkSession, path: str, name: str, snaps: int) -> SnapshotDataset:
    """The dataset of an edge list. Where the preset names its file, ``path`` is the folder
    above; headed files are read by their columns."""
    settings = preset(name, snaps)
    if "edge_file" in settings:
        path = f"{path.rstrip('/')}/{settings['edge_file']}"
    rows = read_edge_csv(spark, path) if path.endswith(".csv") else read_edge_lines(spark, path, settings["skiprows"], settings.get("sep"))
    return snapshot_dataset(numbered_events(rows), **settings)
