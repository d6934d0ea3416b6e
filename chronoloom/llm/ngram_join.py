"""Exact Jaccard self-join of word n-gram sets, as a blocked sparse product.

Rows of the incidence matrix are documents, columns are n-grams (64-bit hashes). Equal
sets form one row. Columns have a global order: first those that are not known to be
frequent, by hash, then the frequent ones from the rarest. Two sets with Jaccard
similarity t or more share k columns among the first ``n - ceil(t n) + k`` of either, so
only these entries are multiplied: Spark deals the column blocks by hash. Documents with
fewer entries in common columns than their size asks for are taken out first.

A column with m rows is not expanded into all m * m pairs. First each row of a column is
paired with the column's smallest row; pairs that pass the size-derived bounds are counted
over their whole sets, and components of the links found that way are formed. Columns
that still join different components are then multiplied. Narrow ones (NARROW rows at
most) give pairs across components, whose overlap counts are accumulated over all narrow
columns; with the columns that may be common beyond these, a count below the bound that
follows from the two sizes discards the pair, and the others are counted over their whole
sets. Wide ones are multiplied in tiles: rows are dealt by size, only tiles that share a
wide column and whose sizes are close enough to link meet, and a tile returns no more
links than it has rows. No link between two different components is lost, whatever m is.

Columns of very many rows are known from the count of frequent ones. They are dealt to
many tasks by their documents; what is needed of all their rows is aggregated before the
shuffle and joined back as a small table.

The list of frequent columns only steers the order and this split, so its bound costs no
exactness.

Defined results: null or empty texts and texts without words have an empty set, no
links and themselves as component; with fewer than n words the whole sequence is the
only n-gram. Rows with equal texts are one class. Rows with a null id get a null
component. Rows that repeat an id are one document in links. Of several ways to the same
component the smallest id names it. An empty table gives no rows. Columns other than id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, stash, text_bytes
from .graph import components
from .words import NOT_SPACE, find_sorted, gram_hash, mix, split_words

#: Frequent columns that are broadcast at most: 16 bytes each.
FREQUENT = 200_000
#: Ids that are broadcast at most; beyond that a shuffled join takes their place.
SMALL_IDS = 2_000_000
#: One more entry of a row is multiplied for each so many, so that linked rows have more
#: than one of them in common.
SPARE = 16
#: Columns of so many rows at most give pairs; wider ones are multiplied in tiles.
NARROW = 64
#: Rows of a block, and columns that are multiplied at once.
TILE, COLUMNS = 256, 4096
#: A column of one in so many n-grams of the corpus, and of so many rows at least, is hot;
#: there are no more of them than that. Hot ones are dealt to so many tasks.
HOT, LEAST_HOT, SALTS = 20_000, 1000, 256
#: How often documents with too few common entries are taken out.
CORE_ROUNDS = 2
_SETS = "doc_id long, n int, s1 long, s2 long, prefix array<long>"


def _grams(part: pa.RecordBatch, column: int, n: int):
    """N-gram hashes of all texts of a batch, and offsets of each text's own."""
    words = split_words(*text_bytes(part.column(column)), NOT_SPACE)
    count = np.diff(words.first)
    grams = gram_hash(words.hash, n)
    ok = np.zeros(len(grams), dtype=bool)
    if len(grams):
        ok = words.doc[: len(grams)] == words.doc[n - 1 :]
    per_doc = np.maximum(count - n + 1, 0)
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return grams[ok], np.concatenate([[0], np.cumsum(per_doc)])
    own = grams[ok]
    at = np.concatenate([[0], np.cumsum(per_doc)])
    whole = np.array([gram_hash(words.hash[words.first[d] : words.first[d + 1]], int(count[d]))[0] for d in short], dtype=np.uint64)
    per_doc[short] = 1
    return np.insert(own, at[short], whole), np.concatenate([[0], np.cumsum(per_doc)])


def _unique_rows(grams: np.ndarray, at: np.ndarray):
    """Sorted distinct n-grams of each text, and their offsets."""
    parts = []
    for i in range(len(at) - 1):
        own = np.sort(grams[at[i] : at[i + 1]])
        if len(own) > 1:
            own = own[np.r_[True, own[1:] != own[:-1]]]
        parts.append(own)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def _frequent(n: int, least: int, hold: int = 1_500_000):
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        value, times = np.unique(np.concatenate(held), return_counts=True)
        keep = times >= least
        return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in chunks(batches, "text"):
            grams, _ = _grams(part, 0, n)
            held.append(grams)
            size += len(grams)
            if size > hold:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return run


def _sets(n: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rank = frequent.value
        for part in chunks(batches, "text"):
            flat, at = _unique_rows(*_grams(part, 1, n))
            size = np.diff(at)
            take = np.where(size > 0, np.minimum(size, size - -(-percent * size // 100) + 1 + size // SPARE), 0)
            heavy = np.zeros(len(flat), dtype=np.int64)
            where, found = find_sorted(table, flat)
            heavy[where] = rank[found]
            doc = np.repeat(np.arange(len(size)), size)
            ordered = flat
            with_heavy = np.unique(doc[where])
            if len(with_heavy):
                ordered = flat.copy()
                for d in with_heavy:
                    own = flat[at[d] : at[d + 1]]
                    ordered[at[d] : at[d + 1]] = own[np.argsort(heavy[at[d] : at[d + 1]], kind="stable")]
            place = np.arange(len(flat)) - at[doc]
            prefix = ordered[place < take[doc]].view(np.int64)
            total, other = _running(flat), _running(mix(flat ^ np.uint64(0x5851F42D4C957F2D)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(size.astype(np.int32)),
                    pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                    pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(prefix)),
                ],
                names=["doc_id", "n", "s1", "s2", "prefix"],
            )

    return run


def _whole_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            flat, at = _unique_rows(*_grams(part, 1, n))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))], names=["doc", "grams"])

    return run


def keep_ids(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (or, by left_anti, is not) among the ids: broadcast only where
    their number is counted and small, else by a shuffled join."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, key, how)


def _window(hot: list[int]):
    """Columns as groups; a hot one is dealt into many by its documents."""
    salt = F.when(F.col("gram").isin(hot), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")) if hot else F.lit(None).cast("int")
    return Window.partitionBy("gram", salt)


def _columns(entries: DataFrame, hot: list[int]) -> DataFrame:
    """The entries of columns with more than one row, and those of all hot ones."""
    return entries.withColumn("m", F.count("*").over(_window(hot))).where((F.col("m") > 1) | F.col("gram").isin(hot)).drop("m")


def _of_columns(entries: DataFrame, hot: list[int], **values) -> DataFrame:
    """Entries with aggregates of their column: by a window where columns are of bounded
    size; those of hot ones are partial sums, joined as a small table."""
    inside = entries.select("*", *[v.over(_window(hot)).alias(k) for k, v in values.items()])
    if not hot:
        return inside
    totals = entries.where(F.col("gram").isin(hot)).groupBy("gram").agg(*[v.alias(f"all_{k}") for k, v in values.items()])
    joined = inside.join(F.broadcast(totals), "gram", "left")  # HOT rows at most
    return joined.select(*entries.columns, *[F.coalesce(f"all_{k}", k).alias(k) for k in values])


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets are similar enough."""
    whole = keep_ids(whole, "doc", pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    one, two = (whole.select(F.col("doc").alias(x), F.col("grams").alias(f"{x}_grams")) for x in "ab")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("shared"), F.size("a_grams").alias("na"), F.size("b_grams").alias("nb")).where(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b")


def _product(percent: int):
    """Links between the two sides of a tile, for pairs of different components: the
    product of the sides' incidence matrices, column block by column block."""

    def run(table: pa.Table) -> pa.Table:
        doc, part = table.column("doc").to_numpy(), table.column("component").to_numpy()
        side, same = table.column("side").to_numpy(), table.column("same").to_numpy()
        sets = table.column("grams").combine_chunks()
        sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
        at, flat = np.r_[0, np.cumsum(np.diff(sets.offsets.to_numpy()))], sets.flatten().to_numpy()
        size = np.diff(at)
        left = np.flatnonzero(side == 0)
        right = left if same.any() else np.flatnonzero(side == 1)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        used = np.flatnonzero(times > 1)
        narrow = np.full(len(times), -1)
        narrow[used] = np.arange(len(used))
        column = narrow[column]
        row = np.repeat(np.arange(len(size)), size)
        counts = np.zeros((len(left), len(right)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for c in range(0, len(used), COLUMNS):
            s = slice(*np.searchsorted(column, [c, c + COLUMNS]))
            block = np.zeros((len(size), COLUMNS), dtype=np.float32)
            block[row[s], column[s] - c] = 1
            counts += block[left] @ block[right].T
        union = size[left][:, None] + size[right][None, :] - counts
        i, j = np.nonzero((part[left][:, None] != part[right][None, :]) & (doc[left][:, None] != doc[right][None, :]) & (100 * counts >= percent * union))
        a, b = np.minimum(doc[left[i]], doc[right[j]]), np.maximum(doc[left[i]], doc[right[j]])
        # links of a tile that join components anew: no more than it has rows
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        keep = []
        for k, (p, q) in enumerate(zip(part[left[i]].tolist(), part[right[j]].tolist(), strict=True)):
            p, q = find(p), find(q)
            if p != q:
                root[p] = q
                keep.append(k)
        return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})

    return run


def _products(wide: DataFrame, rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links between rows (doc, size, family, component) of different components of a
    family, as tiles of about TILE by TILE rows. A tile holds sizes of one class; classes
    are so wide that linked sizes lie in the same or in neighbouring ones. The largest
    component of a family is not multiplied with itself."""
    largest = rows.groupBy("family", "component").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("core"))
    classed = rows.join(largest, "family").select("doc", "family", "component", (F.col("component") == F.col("core")).cast("int").alias("core"), F.floor(F.log(F.col("size") * 1.0) / F.lit(np.log(100 / percent)) + 1e-9).cast("int").alias("level"))
    group = ["family", "core", "level"]
    counts = classed.groupBy(*group).agg(F.ceil(F.count("*") / TILE).cast("int").alias("n"))
    sub = F.pmod(F.xxhash64("doc"), F.col("n")).cast("int")
    placed = stash(classed.join(counts, group).select("doc", "family", "component", F.struct("core", "level", sub.alias("sub")).alias("tile")))
    # tiles that share a column; a row for each tile and column, not for each document
    shared = stash(wide.select("doc", "gram").join(placed, "doc").select("family", "gram", "tile").distinct())
    x, y = shared.alias("x"), shared.alias("y")
    near = "x.family = y.family and x.gram = y.gram and x.tile <= y.tile and abs(x.tile.level - y.tile.level) <= 1 and x.tile.core + y.tile.core < 2"
    meet = stash(x.join(y, F.expr(near)).select("x.family", F.col("x.tile").alias("t1"), F.col("y.tile").alias("t2")).distinct())
    one = meet.join(placed.withColumnRenamed("tile", "t1"), ["family", "t1"]).withColumn("side", F.lit(0))
    two = meet.where("t1 != t2").join(placed.withColumnRenamed("tile", "t2"), ["family", "t2"]).withColumn("side", F.lit(1))
    keyed = one.unionByName(two).select("family", "doc", "component", "t1", "t2", "side", (F.col("t1") == F.col("t2")).alias("same"))
    return keyed.join(whole, "doc").groupBy("family", "t1", "t2").applyInArrow(_product(percent), "a long, b long")


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 75, frequent_in: int = 3, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    common = texts.select("text").mapInArrow(_frequent(n, frequent_in), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = common.orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas()
    table = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(table)
    rank = (len(table) - np.arange(len(table)))[order]  # the most frequent column is last of all
    frequent = spark.sparkContext.broadcast((table[order], rank))
    sets = stash(texts.mapInArrow(_sets(n, percent, frequent), _SETS))
    whole_sum = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = top["gram"][top["n"] >= max(LEAST_HOT, whole_sum / HOT)].tolist()

    keyed = sets.select("doc_id", "n", "s1", "s2")
    class_key = ["n", "s1", "s2"]
    reps = stash(keyed.where("n > 0 and doc_id is not null").groupBy(*class_key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # classes with a thousandth of all rows each: a thousand at most, which need no shuffle
    large_class = F.col("copies") >= max(100, sets.count() / 1000)
    large = F.broadcast(reps.where(large_class).drop("copies"))
    in_large = keyed.join(large, class_key)
    others = keyed.join(large, class_key, "left_anti").join(reps.where(~large_class).drop("copies"), class_key, "left")
    members = stash(in_large.unionByName(others).select("doc_id", "n", "rep"))
    copies = members.where("doc_id != rep").select("doc_id")
    rows = keep_ids(sets.where("n > 0 and doc_id is not null"), "doc_id", copies, "left_anti")

    # the entries of the product: one row for each document and column
    sizes = rows.select(F.col("doc_id").alias("doc"), F.col("n").alias("size"))
    shared = stash(_columns(rows.select(F.col("doc_id").alias("doc"), F.explode("prefix").alias("gram")), hot))
    # a linked document has that many entries in common with one other document
    few = F.expr(f"1 + ({percent} * size + 99) div 100 div {SPARE}")
    for _ in range(CORE_ROUNDS):
        rich = shared.groupBy("doc").agg(F.count("*").alias("m")).join(sizes, "doc").where(F.col("m") >= few).select("doc", "size")
        shared = stash(_columns(shared.join(rich, "doc", "left_semi"), hot), replaces=shared)
    whole = stash(keep_ids(texts, "doc_id", shared.select(F.col("doc").alias("doc_id")).distinct()).mapInArrow(_whole_sets(n), "doc long, grams array<long>"))

    # what a row can have in common with another one: its columns that others have too
    most = _columns(whole.select("doc", F.explode("grams").alias("gram")), hot).groupBy("doc").agg(F.count("*").alias("most"))
    alive = stash(most.join(sizes, "doc").where(f"100 * most >= {percent} * size"))
    shared = stash(_columns(shared.join(alive, "doc"), hot), replaces=shared)
    enough = f"{100 + percent} * least(x.most, y.most) >= {percent} * (x.size + y.size)"
    pairs = _of_columns(shared, hot, x=F.min(F.struct("doc", "size", "most"))).withColumn("y", F.struct("doc", "size", "most"))
    stars = stash(pairs.where(f"x.doc != y.doc and {enough}").select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct())
    links = stash(_verified(stars, whole, percent))
    found = stash(components(links))

    # columns that still join different components
    placed = shared.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = _of_columns(placed, hot, lo=F.min("component"), hi=F.max("component"), m=F.count("*"), first=F.min("doc"))
    open_ = stash(open_.where("lo != hi").drop("lo", "hi"), replaces=shared)
    wide = open_.where(F.col("m") > NARROW)
    beyond = wide.groupBy("doc").agg(F.count("*").alias("beyond"))
    narrow = open_.where(F.col("m") <= NARROW).join(beyond, "doc", "left").withColumn("beyond", F.coalesce("beyond", F.lit(0)))
    # entries that are not in the product
    rest = F.greatest(F.lit(0), F.expr(f"({percent} * size + 99) div 100 - 1 - size div {SPARE}"))
    narrow = narrow.select("gram", "doc", "component", "size", "most", "beyond", rest.alias("rest"))
    fits = f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)"
    both = narrow.alias("x").join(narrow.alias("y"), F.expr(f"x.gram = y.gram and x.doc < y.doc and x.component != y.component and {fits} and {enough}"))
    bound = F.expr(f"({percent} * (x.size + y.size) + {99 + percent}) div {100 + percent} - least(x.beyond, y.beyond) - greatest(x.rest, y.rest)")
    counted = both.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), bound.alias("least")).groupBy("a", "b").agg(F.count("*").alias("overlap"), F.first("least").alias("least"))
    pairs = stash(counted.where("overlap >= least").select("a", "b").join(stars, ["a", "b"], "left_anti"))
    links = stash(links.union(_verified(pairs, whole, percent)))
    if not wide.isEmpty():
        # families of rows that wide columns join, with the components that are known by now
        families = components(wide.select(F.col("first").alias("a"), F.col("doc").alias("b")))
        known = components(links).select(F.col("node").alias("doc"), "component")
        rows = wide.select("doc", "size").distinct().join(families.select(F.col("node").alias("doc"), F.col("component").alias("family")), "doc").join(known, "doc", "left")
        rows = stash(rows.select("doc", "size", "family", F.coalesce("component", "doc").alias("component")))
        links = links.union(_products(wide, rows, whole, percent))
    final = components(links)
    return (
        members.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that have a smaller id in their component."""
    found = similar_documents(docs, **options)
    return keep_ids(docs, options.get("doc_id", "doc_id"), found.where("component_id < doc_id").select("doc_id"), "left_anti")
