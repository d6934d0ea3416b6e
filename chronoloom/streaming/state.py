"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def both_ends(events: DataFrame) -> DataFrame:
    """(node, peer, side, batch, eid, ts) of a stream of events that carry their batch."""
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("peer"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("node"), F.col("src").alias("peer"), F.lit(1).alias("side"))))
    return events.select("batch", "eid", "ts", sides.alias("m")).select("batch", "eid", "ts", "m.*")


def mailbox_stream(events: DataFrame, slots: int) -> DataFrame:
    """(node, slot, eid, ts, pos) as nodes' rings change. A micro-batch may hold several
    batches of events; each (batch, side) of a node is one write. State is the ring."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, ring = state.get if state.exists else (0, [])
        held = {int(r[0]): (int(r[1]), int(r[2])) for r in ring}
        rows = pd.concat(list(frames)).sort_values(["batch", "side", "ts", "eid"], kind="stable")
        for _, write in rows.groupby(["batch", "side"], sort=True):
            last = write.iloc[-1]
            held[pos] = (int(last["eid"]), int(last["ts"]))
            pos = (pos + len(write)) % slots
        state.update((pos, [(s, e, t) for s, (e, t) in sorted(held.items())]))
        yield pd.DataFrame([(key[0], s, e, t, pos) for s, (e, t) in sorted(held.items())], columns=["node", "slot", "eid", "ts", "pos"])

    return both_ends(events).groupBy("node").applyInPandasWithState(fold, "node long, slot long, eid long, ts long, pos long", "pos long, ring array<struct<slot:long,eid:long,ts:long>>", "update", GroupStateTimeout.NoTimeout)


def memory_stream(events: DataFrame) -> DataFrame:
    """(node, n, last_ts): how often and when a node was last touched."""
    return both_ends(events).groupBy("node").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def windowed_degrees(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Weighted out-degree of each source in event-time windows behind a watermark."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "src").agg(F.sum("weight").alias("out_deg"), F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each source: events closer than a gap."""
    rows = events.withWatermark("at", late) if late else events
    return rows.groupBy(F.session_window("at", gap).alias("w"), "src").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
