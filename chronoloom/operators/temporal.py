"""As-of lookups and neighbours before a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.events import HOT_FROM, running_in
from chronoloom.scratch import materialise


def asof(queries: DataFrame, history: DataFrame, key: str, at: str, values: list[str], order: str | None = None, hot_from: int = HOT_FROM, ranges: int | None = None) -> DataFrame:
    """The latest history row at or before each query's time, by a union and one window
    for each key: no inequality join. Of equal times the row of the largest ``order``
    counts. Unmatched queries have nulls. Keys of ``hot_from`` rows and more, of which
    there are few, are cut into ranges of their order, and each range starts with the last
    row of the ranges before it."""
    tie = F.col(order) if order else F.lit(0)
    left = queries.withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(0).cast("long")).withColumn("_v", F.lit(None).cast(history.select(F.struct(*values)).schema[0].dataType))
    right = history.select(key, at, F.lit(0).alias("_side"), tie.cast("long").alias("_tie"), F.struct(*values).alias("_v"))
    both = left.unionByName(right, allowMissingColumns=True)
    own = [at, "_side", "_tie"]

    def latest(rows: DataFrame, *unit: str) -> DataFrame:
        before = Window.partitionBy(*unit).orderBy(*own).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_side = 1")

    def found(rows: DataFrame) -> DataFrame:
        return rows.select(*queries.columns, *[F.col(f"_v.{v}").alias(v) for v in values])

    n = both.count()
    if n < hot_from:
        return found(latest(both, key))
    hot = materialise(both.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_from).select(key))
    if hot.isEmpty():
        return found(latest(both, key))
    # at most n / hot_from keys
    hot = F.broadcast(hot)
    cold = latest(both.join(hot, key, "left_anti").select(both.columns), key)
    dealt = both.join(hot, key, "left_semi").select(both.columns).repartitionByRange(ranges or max(8, n // 2_000_000), key, *own)
    large = materialise(dealt.withColumn("_range", F.spark_partition_id()))
    last = large.groupBy(key, "_range").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct(at, "_tie"))).alias("_v"))
    # a row for each range, and one more for each key at most
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "_range", F.last("_v", ignorenulls=True).over(earlier).alias("_carry"))
    inside = latest(large, key, "_range").join(F.broadcast(carried), [key, "_range"]).withColumn("_v", F.coalesce("_v", "_carry"))
    return found(cold).unionByName(found(inside))


def asof_salted(queries: DataFrame, history: DataFrame, key: str, at: str, values: list[str], width: int, order: str | None = None) -> DataFrame:
    """The same for keys with very many rows: (key, time bucket) is the unit of work, and
    each bucket starts with the last row of the buckets before it."""
    bucket = F.floor(F.col(at) / width).cast("long")
    tie = F.col(order) if order else F.lit(0)
    rows = history.withColumn("_b", bucket)
    last = rows.groupBy(key, "_b").agg(F.max_by(F.struct(*values), F.struct(F.col(at), tie)).alias("_v"))
    asked = queries.withColumn("_b", bucket)
    spans = asked.select(key, "_b").distinct().withColumn("_side", F.lit(0)).unionByName(last.select(key, "_b", F.lit(1).alias("_side"), "_v"), allowMissingColumns=True)
    carried = spans.withColumn("_carry", F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b", "_side").rowsBetween(Window.unboundedPreceding, 0))).where("_side = 0").select(key, "_b", "_carry")
    left = asked.join(carried, [key, "_b"]).withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(0).cast("long"))
    right = rows.select(key, at, "_b", F.lit(0).alias("_side"), tie.cast("long").alias("_tie"), F.struct(*values).alias("_v"))
    both = left.unionByName(right, allowMissingColumns=True)
    before = Window.partitionBy(key, "_b").orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.coalesce(F.last("_v", ignorenulls=True).over(before), "_carry")).where("_side = 1")
    return found.select(*queries.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def node_histories(history: DataFrame, value: str, size: int = 1024) -> DataFrame:
    """(node, block, history): each node's values in order of (ts, ordinal), at most
    ``size`` of them in a row."""
    placed = running_in(history.select("node", "ts", "ordinal", F.col(value).alias("value")), "node", ["ts", "ordinal"], "_n")
    rows = placed.groupBy("node", F.floor(F.col("_n") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("ts", "ordinal", "value"))).alias("h"))
    return rows.select("node", "block", F.transform("h", lambda x: F.struct(x["ts"].alias("ts"), x["value"].alias("value"))).alias("history"))


def recent_k(edges: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """(root_eid, root, nbr_eid, nbr, dt, rank) of the k latest earlier events of each
    event's source. Numbers inside a source give the places of the wanted rows, which an
    equi-join fetches; events of the same time are no neighbours when ``strict``."""
    own = running_in(edges.select("eid", "src", "dst", "ts"), "src", ["ts", "eid"], "rn", tie="ts", tie_name="earlier")
    before = F.col("earlier") if strict else F.col("rn")
    wanted = own.select(F.col("eid").alias("root_eid"), F.col("src").alias("root"), F.col("ts").alias("root_ts"), before.alias("before")).where("before > 0")
    wanted = wanted.withColumn("rn", F.explode(F.sequence(F.greatest(F.lit(0), F.col("before") - k), F.col("before") - 1)))
    rows = own.select(F.col("src").alias("root"), "rn", F.col("eid").alias("nbr_eid"), F.col("dst").alias("nbr"), F.col("ts").alias("nbr_ts"))
    return wanted.join(rows, ["root", "rn"]).select("root_eid", "root", "nbr_eid", "nbr", (F.col("root_ts") - F.col("nbr_ts")).alias("dt"), (F.col("before") - F.col("rn")).alias("rank"))


def _with_roots(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots and events numbered together: n is the number of events of the root before."""
    tagged = edges.select(F.col("src").alias("root"), "ts", F.lit(1).alias("is_edge"), "eid", F.col("dst").alias("nbr")).unionByName(roots.select("root", F.col("root_ts").alias("ts"), F.lit(0).alias("is_edge")).distinct(), allowMissingColumns=True)
    # at equal times roots come first, so equal times are not before them
    return running_in(tagged, "root", ["ts", "is_edge", "eid"], "n", value=F.col("is_edge").cast("long"))


def _fetched(wanted: DataFrame, ranked: DataFrame) -> DataFrame:
    rows = ranked.where("is_edge = 1").select("root", "n", F.col("eid").alias("nbr_eid"), "nbr", F.col("ts").alias("nbr_ts"))
    return wanted.join(rows, ["root", "n"]).withColumn("dt", F.col("root_ts") - F.col("nbr_ts"))


def recent_k_of(roots: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(root, root_ts, nbr_eid, nbr, dt, rank): the k latest events of ``src = root``
    strictly before any root's time."""
    ranked = _with_roots(roots, edges)
    wanted = ranked.where("is_edge = 0 and n > 0").select("root", F.col("ts").alias("root_ts"), F.col("n").alias("before"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - k), F.col("n") - 1)).alias("n"))
    return _fetched(wanted, ranked).select("root", "root_ts", "nbr_eid", "nbr", "dt", (F.col("before") - F.col("n")).alias("rank"))


def recent_lists(asked: DataFrame, edges: DataFrame, k: int, hot_from: int = HOT_FROM, ranges: int | None = None) -> DataFrame:
    """(eid, side, near) for each row of asked (eid, side, root, root_ts): the k latest
    events of ``src = root`` strictly before, the latest first, as a list of (nbr, dt, feat).
    edges: (eid, src, dst, ts, feat). A root's events and questions meet in one order, and
    a pass over it keeps the last k events, so that none is repeated for the questions.
    Roots of ``hot_from`` rows and more, of which there are few, are cut into ranges of
    their order, and each range starts with the last k events before it."""
    own = ["ts", "is_edge", "eid"]
    # at equal times questions come first, so equal times are not before them
    rows = edges.select(F.col("src").alias("root"), "ts", F.lit(1).alias("is_edge"), "eid", F.lit(0).alias("side"), F.col("dst").alias("nbr"), "feat")
    rows = rows.unionByName(asked.select("root", F.col("root_ts").alias("ts"), F.lit(0).alias("is_edge"), "eid", F.col("side").cast("int").alias("side")), allowMissingColumns=True)
    rows = rows.withColumn("_range", F.lit(0))
    names = rows.columns
    n = rows.count()
    if n >= hot_from:
        hot = materialise(rows.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_from).select("root"))
        if not hot.isEmpty():
            # at most n / hot_from roots
            some = F.broadcast(hot)
            dealt = rows.join(some, "root", "left_semi").repartitionByRange(ranges or max(8, n // 2_000_000), "root", *own, "side")
            large = materialise(dealt.withColumn("_range", F.spark_partition_id()).select(names))
            # k rows for each range and root at most, sent to the ranges that come later
            back = lambda *unit: F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("ts"), F.desc("eid")))
            last = large.where("is_edge = 1").withColumn("_back", back("root", "_range")).where(F.col("_back") <= k).drop("_back")
            later = large.select("root", F.col("_range").alias("_to")).distinct()
            sent = last.join(later, "root").where(F.col("_range") < F.col("_to")).withColumn("_back", back("root", "_to")).where(F.col("_back") <= k)
            carried = sent.withColumn("_range", F.col("_to")).select(names)
            rows = rows.join(some, "root", "left_anti").select(names).unionByName(large).unionByName(carried)
    value = dict(edges.select("dst", "feat", (F.col("ts") - F.col("ts")).alias("dt")).dtypes)
    kind = f"eid long, side int, near array<struct<nbr:{value['dst']},dt:{value['dt']},feat:{value['feat']}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not len(b):
                continue
            t = (b if kept is None else pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0])
            edge = t.column("is_edge").to_numpy(zero_copy_only=False).astype(np.int64)
            root, cut = (t.column(c).to_numpy(zero_copy_only=False) for c in ("root", "_range"))
            before = np.cumsum(edge) - edge
            first = np.r_[True, (root[1:] != root[:-1]) | (cut[1:] != cut[:-1])]
            base = before[first][np.cumsum(first) - 1]
            at, where = np.flatnonzero(edge == 1), np.flatnonzero(edge == 0)
            count = np.minimum(before[where] - base[where], k)
            offset = np.r_[0, np.cumsum(count)]
            found = pa.array(at[np.repeat(before[where] - 1 + offset[:-1], count) - np.arange(offset[-1])])
            ts = t.column("ts")
            dt = pc.subtract(ts.take(pa.array(np.repeat(where, count))), ts.take(found))
            near = pa.StructArray.from_arrays([t.column("nbr").take(found), dt, t.column("feat").take(found)], names=["nbr", "dt", "feat"])
            yield pa.RecordBatch.from_arrays([*(t.column(c).take(pa.array(where)) for c in ("eid", "side")), pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), near)], names=["eid", "side", "near"])
            kept = t.take(pa.array(at[max(base[-1], len(at) - k) :]))

    return rows.repartition("root", "_range").sortWithinPartitions("root", "_range", *own).mapInArrow(run, kind)


def uniform_k_of(roots: DataFrame, edges: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(root, root_ts, nbr_eid, nbr, dt, rank): k draws with replacement from the events
    before any root's time, by an arithmetic hash of root, time and draw."""
    ranked = _with_roots(roots, edges)
    prime = F.lit(2147483647)
    own = F.pmod(F.pmod("root", prime) * 31 + F.pmod("ts", prime), prime)
    draw = F.pmod(own * 48271 + F.col("rank") * 7919 + seed, prime)
    wanted = ranked.where("is_edge = 0 and n > 0").withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    return _fetched(wanted.select("root", F.col("ts").alias("root_ts"), "rank", F.pmod(draw, F.col("n")).alias("n")), ranked).select("root", "root_ts", "nbr_eid", "nbr", "dt", "rank")


def weighted_k_of(roots: DataFrame, edges: DataFrame, k: int, mass: str = "mass", seed: int = 7) -> DataFrame:
    """(root, root_ts, nbr_eid, nbr, dt, rank): k draws with replacement from the events of
    ``src = root`` before any root's time, an event as likely as its mass, a whole number;
    events without mass are not drawn. A draw is a place in the running sum of the root's
    masses. Sums are cut into stretches as wide as the root's mean mass, an event stands in
    every stretch that it reaches into (two for each event, on average), and a draw meets
    the events of its own stretch only: an equi-join, and one or two rows for a draw."""
    held = edges.select(F.col("src").alias("root"), "ts", F.lit(1).alias("is_edge"), "eid", F.col("dst").alias("nbr"), F.greatest(F.lit(0), F.coalesce(F.col(mass), F.lit(0))).cast("long").alias("m"))
    asked = roots.select("root", F.col("root_ts").alias("ts"), F.lit(0).alias("is_edge")).distinct()
    tagged = materialise(held.unionByName(asked, allowMissingColumns=True))
    placed = materialise(running_in(tagged, "root", ["ts", "is_edge", "eid"], "before", value=F.coalesce("m", F.lit(0).cast("long"))))
    width = placed.where("is_edge = 1 and m > 0").groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("m") / F.count("*"))).cast("long").alias("width"))
    wide = placed.join(width, "root")
    prime = F.lit(2147483647)
    own = F.pmod(F.pmod("root", prime) * 31 + F.pmod("ts", prime), prime)
    # two residues make a number up to 2 ** 62, as sums of masses may be large
    low = F.pmod(own * 48271 + F.col("rank") * 7919 + seed, prime)
    high = F.pmod(own * 16807 + F.col("rank") * 104729 + seed, prime)
    draws = wide.where("is_edge = 0 and before > 0").withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    draws = draws.select("root", F.col("ts").alias("root_ts"), "rank", F.pmod(high * prime + low, F.col("before")).alias("at"), "width")
    draws = draws.withColumn("stretch", F.expr("at div width"))
    reach = F.explode(F.expr("sequence(before div width, (before + m - 1) div width)"))
    events = wide.where("is_edge = 1 and m > 0").withColumn("stretch", reach).select("root", "stretch", F.col("before").alias("first"), "m", F.col("eid").alias("nbr_eid"), "nbr", F.col("ts").alias("nbr_ts"))
    met = draws.join(events, ["root", "stretch"]).where("at >= first and at < first + m")
    return met.select("root", "root_ts", "nbr_eid", "nbr", (F.col("root_ts") - F.col("nbr_ts")).alias("dt"), "rank")


def each_neighbour_once(found: DataFrame) -> DataFrame:
    """Of a root's samples with the same neighbour the one of the smallest rank."""
    best = found.groupBy("root", "root_ts", "nbr").agg(F.min(F.struct("rank", "nbr_eid", "dt")).alias("m"))
    return best.select("root", "root_ts", "m.nbr_eid", "nbr", "m.dt", "m.rank")


def of_part(edges: DataFrame, parts: DataFrame, part: int) -> DataFrame:
    """Events whose neighbour a part owns: what a local sampler may see."""
    return edges.join(parts.where(F.col("part") == part).select(F.col("node").alias("dst")), "dst", "left_semi").select(edges.columns)


def batch_roots(batches: DataFrame) -> DataFrame:
    """(split, batch, root, root_ts): both ends of a batch's events at its last time."""
    last = batches.groupBy("split", "batch").agg(F.max("ts").alias("root_ts"))
    ends = batches.select("split", "batch", F.explode(F.array("src", "dst")).alias("root")).distinct()
    return ends.join(last, ["split", "batch"])


def uniform_k(edges: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(root_eid, nbr_eid, draw): k draws with replacement from the events before each
    event of its source, by an arithmetic hash. A draw is a place in the source's order,
    and an equi-join fetches what stands there."""
    own = running_in(edges.select("eid", "src", "ts"), "src", ["ts", "eid"], "rn", tie="ts", tie_name="before")
    draws = own.where("before > 0").select(F.col("eid").alias("root_eid"), "src", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("draw"))
    placed = draws.withColumn("rn", F.pmod(F.pmod((F.pmod("root_eid", F.lit(2147483647)) * k + F.col("draw")) * 48271 + seed, F.lit(2147483647)), F.col("before")))
    return placed.join(own.select("src", "rn", F.col("eid").alias("nbr_eid")), ["src", "rn"]).select("root_eid", "nbr_eid", "draw")


def hops(edges: DataFrame, roots: DataFrame, fanout: list[int], sample=recent_k_of) -> DataFrame:
    """(hop, root, root_ts, nbr_eid, nbr, dt, rank): the neighbours of a hop are the roots
    of the next one, at the same time. sample: recent_k_of, uniform_k_of or one of its own."""
    out, at = None, roots.select("root", "root_ts").distinct()
    for hop, k in enumerate(fanout, 1):
        # written: the next hop starts from it, and the result holds it too
        found = materialise(sample(at, edges, k).withColumn("hop", F.lit(hop).cast("long")))
        out = found if out is None else out.unionByName(found)
        at = found.select(F.col("nbr").alias("root"), "root_ts").distinct()
    return out


def time_encoding(dt: Column, dim: int) -> Column:
    """cos(dt * 10 ** (-9 i / (dim - 1))) for i below dim."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.cos(dt * F.pow(F.lit(10.0), -9.0 * i / max(1, dim - 1))))
