"""Time windows: equal-count and sliding snapshots, their degrees, labels and ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.events import running_in, running_total
from chronoloom.operators.partitioning import mixed
from chronoloom.scratch import materialise


def spine(df: DataFrame, n: int) -> DataFrame:
    """Snapshot numbers 0 .. n - 1."""
    return df.sparkSession.range(n).select(F.col("id").alias("snap"))


def per_snapshot(total: int, snaps: int) -> int:
    return max(1, -(-total // snaps))


def equal_count(numbered: DataFrame, snaps: int, total: int | None = None) -> DataFrame:
    """``snap``: slices of ceil(total / snaps) events by row number."""
    per = per_snapshot(numbered.count() if total is None else total, snaps)
    return numbered.withColumn("snap", F.floor(F.col("rn") / per).cast("long"))


def snapshot_stats(snap_edges: DataFrame, snaps: int) -> DataFrame:
    """Events, first and last time of every snapshot, empty ones too."""
    each = snap_edges.groupBy("snap").agg(F.count("*").alias("n_edges"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"))
    return spine(snap_edges, snaps).join(each, "snap", "left").select("snap", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "t_start", "t_end")


def snapshot_ends(snap_edges: DataFrame, snaps: int) -> DataFrame:
    """Last time of each snapshot; empty ones take over the end before them."""
    stats = snapshot_stats(snap_edges, snaps)
    # one row for each snapshot: a small table
    return stats.select("snap", F.last("t_end", ignorenulls=True).over(Window.orderBy("snap").rowsBetween(Window.unboundedPreceding, 0)).alias("end_ts"))


def degrees(snap_edges: DataFrame) -> DataFrame:
    """Weighted in- and out-degree of the nodes that a snapshot touches, and the label
    log(1 + in-degree); other nodes have zeros throughout. One shuffle: both ends of an
    edge are rows of the same aggregation."""
    ends = snap_edges.select("snap", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("weight").alias("o")), F.struct(F.col("dst").alias("node"), F.col("weight").alias("i"), F.lit(0.0).alias("o")))).alias("e"))
    return ends.groupBy("snap", F.col("e.node").alias("node")).agg(F.sum("e.i").alias("in_deg"), F.sum("e.o").alias("out_deg")).withColumn("label", F.log1p("in_deg"))


def masked_windows(edges: DataFrame, window: int, lags: int, skiptime: int = 0) -> DataFrame:
    """Overlapping equal-time windows [start + i w, start + (i + lags + 1) w) for i below
    window - lags; empty windows are skipped and the others renumbered. Each event is
    sent to its few candidate windows, which are then tested exactly."""
    times = edges.select("ts").distinct()
    if skiptime:
        first = times.orderBy("ts").limit(skiptime + 1).agg(F.max("ts").alias("t"), F.count("*").alias("n")).first()
        if first["n"] <= skiptime:
            return edges.withColumn("snap", F.lit(0).cast("long")).limit(0)
        start = first["t"]
        end = edges.agg(F.max("ts")).first()[0]
    else:
        start, end = edges.agg(F.min("ts"), F.max("ts")).first()
        if start is None:
            return edges.withColumn("snap", F.lit(0).cast("long"))
    window = max(1, window)
    width = max(1.0, float(max(start + 1, end) - start) / window)
    count = max(1, window - lags)
    mid = F.floor((F.col("ts") - start) / width)
    near = F.sequence(F.greatest(mid - lags - 1, F.lit(0)), F.least(mid + 1, F.lit(count - 1)))
    i = F.col("_i")
    hits = edges.where((F.col("ts") >= start) & (F.greatest(mid - lags - 1, F.lit(0)) <= F.least(mid + 1, F.lit(count - 1)))).withColumn("_i", F.explode(near)).where((F.col("ts") >= start + i * width) & (F.col("ts") < start + (i + lags + 1) * width))
    used = hits.select("_i").distinct().withColumn("snap", F.row_number().over(Window.orderBy("_i")).cast("long") - 1)
    # at most ``window`` rows
    return hits.join(F.broadcast(used), "_i").drop("_i")


def fixed_batches(numbered: DataFrame, batch_size: int) -> DataFrame:
    return numbered.withColumn("snap", F.floor(F.col("rn") / max(1, batch_size)).cast("long"))


def normalised_count(snap_edges: DataFrame, have: int, want: int) -> DataFrame:
    """The first ``want`` snapshots; the last one is repeated if there are fewer."""
    kept = snap_edges.where(F.col("snap") < want)
    if have >= want or have == 0:
        return kept
    again = F.explode(F.sequence(F.lit(have), F.lit(want - 1)))
    last = snap_edges.where(F.col("snap") == have - 1)
    return kept.unionByName(last.withColumn("_s", again).withColumn("snap", F.col("_s").cast("long")).drop("_s"))


def warmup_tags(snaps: DataFrame, start: int, split: str) -> DataFrame:
    """Snapshots before a split's start only warm up state."""
    return snaps.withColumn("chain", F.when(F.col("snap") < start, "snapshot_warmup").otherwise(f"snapshot_{split}"))


def model_windows(snaps: DataFrame, size: int) -> DataFrame:
    """(at, snap, age): the last ``size`` snapshots before and at each snapshot."""
    back = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    pairs = snaps.select(F.col("snap").alias("at"), back.alias("age"))
    return pairs.select("at", (F.col("at") - F.col("age")).alias("snap"), F.col("age").cast("long").alias("age")).where("snap >= 0")


def novelty_events(numbered: DataFrame, batch_size: int, alpha: float = 1.0, beta: float = 0.5, aggl: float = 0.0, drop_rate: float = 0.0, window_size: int = 1000) -> DataFrame:
    """Information-aware slices: (eid, batch, score, slice, kept). An event repeats if its
    pair has come among the ``window_size`` events before it. A fixed batch scores alpha for
    the share of new events less beta for that of repeated ones, zero at least, in whole
    thousandths; a slice ends where the running score passes ``1 + aggl``. Of repeated
    events a share of ``drop_rate`` is marked as not kept, by a hash. A substitute contract,
    as the original's program is not public. The event before of a pair is found by numbers
    inside the pair and an equi-join, so a pair with very many events is no hot window."""
    pair = F.struct("src", "dst")
    placed = materialise(running_in(numbered.select("eid", "rn", pair.alias("pair")), "pair", ["rn"], "k"))
    last = placed.select("pair", (F.col("k") + 1).alias("k"), F.col("rn").alias("last"))
    again = F.coalesce(F.col("rn") - F.col("last") <= window_size, F.lit(False))
    tagged = materialise(placed.join(last, ["pair", "k"], "left").select("eid", F.floor(F.col("rn") / batch_size).cast("long").alias("batch"), again.alias("again")))
    repeats = F.sum(F.col("again").cast("long"))
    exact = (alpha * (F.count("*") - repeats) - beta * repeats) * 1000 / F.count("*")
    per_batch = materialise(tagged.groupBy("batch").agg(F.greatest(F.lit(0), F.round(exact).cast("long")).alias("units")))
    before = running_total(per_batch, ["batch"], {"_before": F.col("units")})
    slices = before.select("batch", (F.col("units") / 1000).alias("score"), F.floor(F.col("_before") / (1000 * (1 + aggl))).cast("long").alias("slice"))
    # 31 bits of a hash against the share
    dropped = F.col("again") & (mixed(F.col("eid"), 13) < int(drop_rate * 2147483647))
    return tagged.join(slices, "batch").select("eid", "batch", "score", "slice", (~dropped).alias("kept"))


def novelty_cuts(numbered: DataFrame, batch_size: int, **options) -> DataFrame:
    """(batch, score, slice) of ``novelty_events``."""
    return novelty_events(numbered, batch_size, **options).select("batch", "score", "slice").distinct()


def decayed_ends(ends: list[int], steps: list[int], size: int) -> list[int | None]:
    """For each age in a window the number of leading nodes that is left: all of the newest
    snapshot, then by falling steps of a decay the end of so many chunks, the last one again
    where there are more ages than steps."""
    falling = sorted(steps, reverse=True)
    return [None, *[ends[(falling[min(a, len(falling) - 1)]) - 1] if falling else None for a in range(size - 1)]][:size]


def decayed_windows(snap_edges: DataFrame, places: DataFrame, ends: list[int | None], snaps: int) -> DataFrame:
    """(at, age, ...edge): the window of ``len(ends)`` snapshots up to each one, older ones cut
    to the edges among their first nodes. places: (node, place), chunk by chunk. Places are
    joined once, and only edges that some window keeps are repeated for it."""
    one, two = (places.select(F.col("node").alias(e), F.col("place").alias(f"_{e}")) for e in ("src", "dst"))
    reach = F.greatest("_src", "_dst")
    fits = F.array(*[F.when(F.lit(True) if end is None else reach < end, F.lit(age)) for age, end in enumerate(ends)])
    kept = snap_edges.join(one, "src").join(two, "dst").select(*snap_edges.columns, F.explode(F.filter(fits, lambda a: a.isNotNull())).alias("age"))
    at = (F.col("snap") + F.col("age")).cast("long")
    return kept.select(at.alias("at"), F.col("age").cast("long").alias("age"), *[c for c in snap_edges.columns if c != "snap"]).where(F.col("at") < snaps)


def window_mixed(current: DataFrame, previous: DataFrame, places: DataFrame, end: int | None, need: int | None, width: int) -> DataFrame:
    """(node, state) of the first ``need`` nodes: the state of the cut snapshot for its
    first ``end`` ones, behind them that of the snapshot before, or zeros."""
    nodes = places if need is None else places.where(F.col("place") < need)
    joined = nodes.join(current.withColumnRenamed("state", "_c"), "node", "left").join(previous.withColumnRenamed("state", "_p"), "node", "left")
    own = F.col("_c") if end is None else F.when(F.col("place") < end, F.col("_c"))
    return joined.select("node", F.coalesce(own, "_p", F.array_repeat(F.lit(0.0), width)).alias("state"))


def time_windows(edges: DataFrame, at: Column, width: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding calendar windows of an event stream."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return edges.withColumn("w", w).groupBy("w", "src").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
