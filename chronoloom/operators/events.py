"""Canonical events: order, dense ids, splits and batches.

An event set is a DataFrame (eid, src, dst, ts, weight, ...). Its order is (ts, eid)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.scratch import materialise

#: From so many rows on, row numbers are given range by range, not in one window.
RANGED_FROM = 5_000_000
#: Keys of so many rows have their running sums made in ranges.
HOT_FROM = 1_000_000
SPLITS = ("train", "val", "test")


def canonical(df: DataFrame, src: Column, dst: Column, ts: Column, eid: Column, weight: Column | None = None, *more: Column) -> DataFrame:
    weight = F.lit(1.0) if weight is None else weight
    return df.select(eid.cast("long").alias("eid"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), ts.alias("ts"), weight.cast("double").alias("weight"), *more)


def running_total(df: DataFrame, order: Sequence[str], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """For each name the sum of its value over the rows before, by the columns of the
    order, which must tell all rows apart. Small inputs use one window. Large ones are
    dealt into ranges of all the columns, so that ties are cut too, and written with the
    number of their range, which fixes the cut for all that follows. Sums run inside each
    range and are moved by those of the ranges before it: no task sees all rows."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if ranges is None:
        n = df.count()
        if n < RANGED_FROM:
            return df.select("*", *[before(v, Window.orderBy(*order)).alias(k) for k, v in values.items()])
        ranges = max(64, n // 2_000_000)
    named = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    ranged = materialise(named.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    # one row for each range
    offsets = sums.select("_range", *[before(f"_s_{k}", Window.orderBy("_range")).alias(f"_o_{k}") for k in values])
    inside = Window.partitionBy("_range").orderBy(*order)
    run = ranged.select("*", *[before(f"_v_{k}", inside).alias(f"_i_{k}") for k in values]).join(F.broadcast(offsets), "_range")
    return run.select(*df.columns, *[(F.col(f"_i_{k}") + F.col(f"_o_{k}")).alias(k) for k in values])


def with_row_number(df: DataFrame, *order: str, name: str = "rn", ranges: int | None = None) -> DataFrame:
    """0-based row numbers by the columns of the order."""
    return running_total(df, order, {name: F.lit(1).cast("long")}, ranges)


def running_in(df: DataFrame, key: str, order: Sequence[str], name: str, value: Column | None = None, tie: str | None = None, tie_name: str | None = None, hot_from: int = HOT_FROM) -> DataFrame:
    """Sums of a value that is not negative (row numbers, if none is given) over the rows
    before inside each key; with ``tie``, the first column of the order, also the number
    of rows with a smaller one. Keys of fewer than ``hot_from`` rows take one window each;
    the rows of larger keys, of which there are few, are summed in ranges."""
    own = Window.partitionBy(key).orderBy(*order)
    if value is None:
        value = F.lit(1).cast("long")
        sums = {name: (F.row_number().over(own) - 1).cast("long")}
    else:
        sums = {name: F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    if tie:
        sums[tie_name] = (F.rank().over(Window.partitionBy(key).orderBy(tie)) - 1).cast("long")
    in_windows = lambda rows: rows.select("*", *[v.alias(k) for k, v in sums.items()])
    n = df.count()
    if n < hot_from:
        return in_windows(df)
    hot = materialise(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_from).select(key))
    if hot.isEmpty():
        return in_windows(df)
    # at most n / hot_from keys
    hot = F.broadcast(hot)
    cold = in_windows(df.join(hot, key, "left_anti").select(df.columns))
    large = running_total(df.join(hot, key, "left_semi").select(df.columns), [key, *order], {name: value}, ranges=max(8, n // 2_000_000))
    start = F.broadcast(large.groupBy(key).agg(F.min(name).alias("_start")))
    moved = large.join(start, key).withColumn(name, F.col(name) - F.col("_start"))
    if tie:
        moved = moved.join(moved.groupBy(key, tie).agg(F.min(name).alias(tie_name)), [key, tie])
    return cold.unionByName(moved.select(*df.columns, *sums))


def node_ids(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node, id): dense ids by node order over sources, targets and further nodes."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if more is not None:
        nodes = nodes.union(more.select(F.col(more.columns[0]).cast("long")))
    return with_row_number(nodes.distinct(), "node", name="id")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Both ends replaced by dense ids."""
    one = ids.select(F.col("node").alias("src"), F.col("id").alias("_s"))
    two = ids.select(F.col("node").alias("dst"), F.col("id").alias("_d"))
    joined = edges.join(one, "src").join(two, "dst")
    return joined.select(*[F.col({"src": "_s", "dst": "_d"}.get(c, c)).alias(c) for c in edges.columns])


def remap_features(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Feature rows of known nodes, with dense ids."""
    return features.join(ids, "node").select(F.col("id").alias("node"), *[c for c in features.columns if c != "node"])


def after_skiptime(edges: DataFrame, n: int) -> DataFrame:
    """Events from the distinct time number ``n`` (0-based) on; all, if there are fewer."""
    if n <= 0:
        return edges
    first = edges.select("ts").distinct().orderBy("ts").limit(n + 1).agg(F.max("ts").alias("t"), F.count("*").alias("n")).first()
    return edges.where(F.col("ts") >= first["t"]) if first["n"] > n else edges


def split_sizes(total: int, ratio: Sequence[float] = (0.7, 0.15, 0.15)) -> list[int]:
    """Shares of the total rounded down, with one more for the largest fractions; then
    each positive share without events takes one from the largest split, if the events
    are enough for all of them."""
    share = np.maximum(np.array(ratio, dtype=float), 0)
    if not share.any():
        share = np.array([0.7, 0.15, 0.15])
    exact = total * (share / share.sum())
    size = np.floor(exact).astype(int)
    size[np.argsort(size - exact, kind="stable")[: total - size.sum()]] += 1
    empty = (share > 0) & (size == 0)
    if total >= (share > 0).sum():
        size[np.argmax(size)] -= empty.sum()
        size[empty] = 1
    return size.tolist()


def split_bounds(total: int, split: str, ratio: Sequence[float] = (0.7, 0.15, 0.15)) -> tuple[int, int]:
    a, b, _ = split_sizes(total, ratio)
    return {"train": (0, a), "val": (a, a + b), "test": (a + b, total)}[split]


def assign_splits(numbered: DataFrame, ratio: Sequence[float] = (0.7, 0.15, 0.15), total: int | None = None) -> DataFrame:
    """``split`` and the number inside it (``rn_in_split``) from global row numbers."""
    a, b, _ = split_sizes(numbered.count() if total is None else total, ratio)
    rn = F.col("rn")
    split = F.when(rn < a, "train").when(rn < a + b, "val").otherwise("test")
    start = F.when(rn < a, 0).when(rn < a + b, a).otherwise(a + b)
    return numbered.withColumn("split", split).withColumn("rn_in_split", (rn - start).cast("long"))


def event_batches(splits: DataFrame, batch_size: int, world_size: int = 1) -> DataFrame:
    """``batch``: windows of batch_size * world_size events inside a split."""
    return splits.withColumn("batch", F.floor(F.col("rn_in_split") / (batch_size * world_size)).cast("long"))


def capped(batches: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first batches of each split, as many as its limit says; all of a split without."""
    limit = F.lit(None).cast("long")
    for split, n in limits.items():
        limit = F.when(F.col("split") == split, n).otherwise(limit)
    return batches.where(limit.isNull() | (F.col("batch") < limit))


def with_values(rows: DataFrame, values: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with a further column from (key, name); every row must find exactly one value."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    found = values.select(key, F.col(name)).groupBy(key).agg(F.count("*").alias("_n"), F.first(name).alias(name))
    # written: rows are counted before they are used
    out = materialise(rows.join(found, key, "left"))
    wrong = out.where(F.coalesce(F.col("_n"), F.lit(0)) != 1).count()
    if wrong:
        raise ValueError(f"{wrong} rows have no value of {name}, or several")
    return out.select(*rows.columns, name)


def batch_plan(batches: DataFrame, part: Column) -> DataFrame:
    """Events of each split and the smallest and largest number that a part owns."""
    each = batches.withColumn("part", part).groupBy("split", "part").agg(F.count("*").alias("n"))
    return each.groupBy("split").agg(F.sum("n").alias("events"), F.min("n").alias("min_local"), F.max("n").alias("max_local"))


def owned(edges: DataFrame, part: Column, rank: int) -> DataFrame:
    return edges.where(part == rank)


def visible_to(splits: DataFrame, split: str) -> DataFrame:
    """Events that a sampler of a split may see: train sees train, val also val, test all."""
    return splits.where(F.col("split").isin(*SPLITS[: SPLITS.index(split) + 1]))


def pack_index(loc: Column, part: Column, shared: Column) -> Column:
    """48 bits of local index, 14 bits of part, one flag."""
    return loc.bitwiseAND(F.lit((1 << 48) - 1)).bitwiseOR(F.shiftleft(part.cast("long"), 48)).bitwiseOR(F.shiftleft(shared.cast("long"), 62))


def unpack_index(packed: Column) -> tuple[Column, Column, Column]:
    return packed.bitwiseAND(F.lit((1 << 48) - 1)), F.shiftright(packed, 48).bitwiseAND(F.lit((1 << 14) - 1)).cast("int"), F.shiftright(packed, 62).bitwiseAND(F.lit(1)) == 1


def fit_width(feature: Column, width: int) -> Column:
    """A feature vector cut or padded with zeros to a width."""
    return F.slice(F.concat(feature, F.array_repeat(F.lit(0.0), width)), 1, width)
