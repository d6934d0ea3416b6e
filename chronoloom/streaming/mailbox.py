"""The mailbox over an event stream with late and repeated events, in keyed state with timers.

Batches of events are stretches of event time. A node's writes of a stretch are counted as
they come, in whatever order, and go into the ring when the watermark has passed the
stretch's end: then nothing of it can come any more, and the ring is what the batch form
gives for the events that were in time. State of a node is its ring, its position and one
small entry for each open stretch and side, however many events it has."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: State of this kind is kept by this provider only.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "node long, slot long, eid long, ts long, peer long, pos long, touched long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state by the provider that keyed state needs; the
    session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


class Mailbox(StatefulProcessor):
    """Rings of ``slots`` slots; stretches are ``width`` microseconds long."""

    def __init__(self, slots: int, width: int):
        self.slots, self.width = slots, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # flat lists, read and written once for each call: every access is a round trip
        self.held = handle.getValueState("held", "pos long, ring array<bigint>, open array<bigint>")

    def _get(self) -> tuple[int, dict[int, list[int]], dict[tuple[int, int], list[int]]]:
        """Position, slot -> (eid, ts, peer), (batch, side) -> (n, eid, ts, peer)."""
        held = self.held.get()
        if held is None:
            return 0, {}, {}
        pos, ring, entries = held
        return pos, {ring[i]: ring[i + 1 : i + 4] for i in range(0, len(ring), 4)}, {(entries[i], entries[i + 1]): entries[i + 2 : i + 6] for i in range(0, len(entries), 6)}

    def _put(self, pos: int, ring: dict[int, list[int]], entries: dict[tuple[int, int], list[int]]) -> None:
        self.held.update((pos, [x for slot, mail in ring.items() for x in (slot, *mail)], [x for at, own in entries.items() for x in (*at, *own)]))

    def _due(self, batch: int) -> int:
        return (batch + 1) * self.width // 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802
        pos, ring, entries = self._get()
        before = min(entries, default=None)
        for r in rows:  # one entry for each stretch and side, not for each event
            own = entries.setdefault((r["batch"], r["side"]), [0, -1, -1, -1])
            own[0] += 1
            if (r["ts"], r["eid"]) > (own[2], own[1]):
                own[1:] = [r["eid"], r["ts"], r["peer"]]
        self._put(pos, ring, entries)
        first = min(entries)
        if before is None or first[0] < before[0]:  # one timer, for the first stretch to end
            self.handle.registerTimer(self._due(first[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        pos, ring, entries = self._get()
        ready = sorted(k for k in entries if self._due(k[0]) <= now)
        if not ready:
            return
        touched = 0
        for at in ready:
            n, eid, ts, peer = entries.pop(at)
            ring[pos] = [eid, ts, peer]
            pos, touched = (pos + n) % self.slots, (at[0] + 1) * self.width
        self._put(pos, ring, entries)
        if entries:
            self.handle.registerTimer(self._due(min(entries)[0]))
        for slot, mail in ring.items():
            yield Row(node=key[0], slot=slot, eid=mail[0], ts=mail[1], peer=mail[2], pos=pos, touched=touched)

    def close(self) -> None:
        pass


def stretches(events: DataFrame, width: int) -> DataFrame:
    """Events (eid, src, dst, ts in microseconds) with ``batch``, their stretch of time."""
    return events.withColumn("batch", F.floor(F.col("ts") / width).cast("long"))


def mailbox_in_time(events: DataFrame, slots: int, width: int, late: str) -> DataFrame:
    """(node, slot, eid, ts, peer, pos, touched): a node's ring whenever it has changed.
    events: a stream (eid, src, dst, ts in microseconds). An event that comes again counts
    once, one that is later than the watermark allows is left out. The stream has to be
    started inside ``keyed_state``."""
    timed = events.withColumn("at", F.timestamp_micros("ts")).withWatermark("at", late)
    once = stretches(timed.dropDuplicatesWithinWatermark(["eid"]), width)
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("peer"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("node"), F.col("src").alias("peer"), F.lit(1).alias("side"))))
    rows = once.select("at", "batch", "eid", "ts", sides.alias("m")).select("at", "batch", "eid", "ts", "m.*")
    return rows.groupBy("node").transformWithState(Mailbox(slots, width), _OUT, "append", "eventTime")
