"""The mailbox over a stream with late, repeated and restarted micro-batches."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from chronoloom.operators import state as st
from chronoloom.streaming.mailbox import PROVIDER, Mailbox, keyed_state, mailbox_in_time, stretches

WIDTH, START = 60_000_000, 1_000 * 60_000_000  # a minute; event times of the epoch itself count as late


def test_stream_with_late_and_repeated_events_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), 10 + rng.randrange(4), START + i * 7_000_000) for i in range(150)]
    shuffled = sorted(rows, key=lambda r: r[0] + rng.randrange(12))
    kind = "eid long, src long, dst long, ts long"
    files = [shuffled[:50] + rows[:5], shuffled[50:100] + shuffled[40:60], shuffled[100:], [(10_000, 99, 98, START + 150 * 7_000_000 + 20 * WIDTH)], [(5, 1, 11, START + 35_000_000), (10_001, 99, 98, START + 150 * 7_000_000 + 21 * WIDTH)]]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = mailbox_in_time(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3, WIDTH, "5 minutes")
        with keyed_state(spark):
            q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    for n, part in enumerate(files):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n in (1, 4):  # stopped and started again from its checkpoint
            run()
    assert spark.conf.get(PROVIDER[0]) != PROVIDER[1]
    got = spark.read.parquet(out).where("node < 90")
    last = got.groupBy("node", "slot").agg(F.max_by(F.struct("eid", "ts", "peer"), "touched").alias("m")).select("node", "slot", "m.*")
    batch = stretches(spark.createDataFrame(rows, kind), WIDTH)
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in st.mailbox(batch, 3).select("node", "slot", "eid", "ts", "peer").collect()}
    pos = got.groupBy("node").agg(F.max_by("pos", "touched").alias("pos"))
    assert {tuple(r) for r in pos.collect()} == {tuple(r) for r in st.ring_position(batch, 3).collect()}
    assert got.groupBy("node", "touched").count().agg(F.max("count")).first()[0] <= 3  # a hot node's output is its ring


class Held:
    """State, timers and watermark of one key, with the number of accesses."""

    def __init__(self):
        self.value, self.timers, self.calls, self.now = None, set(), 0, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_accesses_to_state_do_not_grow_with_stretches():
    held = Held()
    box = Mailbox(3, 1000)
    box.init(held)
    rows = [Row(batch=b, side=0, eid=b, ts=b * 1000, peer=7) for b in range(100, 200)]
    assert list(box.handleInputRows((1,), iter(rows), held)) == [] and held.calls <= 3 and held.timers == {101}
    box.handleInputRows((1,), iter([Row(batch=90, side=1, eid=500, ts=90_500, peer=8)]), held)
    assert held.timers == {91, 101}
    held.calls, held.now = 0, 101
    out = list(box.handleExpiredTimer((1,), held, None))
    assert {(r["slot"], r["eid"], r["peer"]) for r in out} == {(0, 500, 8), (1, 100, 7)} and held.calls <= 3 and 102 in held.timers
    held.now = 1000
    assert {(r["eid"], r["pos"]) for r in box.handleExpiredTimer((1,), held, None)} == {(197, 2), (198, 2), (199, 2)}
    assert held.value[2] == []
    assert list(box.handleExpiredTimer((1,), held, None)) == []
