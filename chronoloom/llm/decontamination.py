"""Benchmark decontamination with a distributed positional inverted index.

The training texts are inverted in slices of bounded size. A slice's index is one row of
a stored table: its documents, its terms in order, and the places of each term. The table
holds every token's posting, depends on no benchmark, and is spread like the texts.

The benchmark is the stated query set. It is cut into windows of ``window`` words, in
blocks of bounded size that are searched one after the other. A window's terms are
ordered from the rarest, by how often the stored postings say that they occur. In each
slice the places of a window's rarest term, moved by its offset, are intersected with
those of the next terms until all agree (exact phrase), or until the next two stand
within ``slop`` words of their places (proximity match, where the item has no exact one).
A window whose rarest term was edited is found by other windows of its item or not at all.

Defined results: null or empty texts have no words and are never hit; benchmark rows
with a null id, null text or no words make no window; repeated items each count; equally
rare terms rank by their place in the window; repeated rows repeat results; an empty
benchmark or corpus gives zero hits or no rows; columns other than the id and text
columns are ignored by the searches and kept by ``decontaminate``; very long texts are a
slice of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.scratch import shared_folder

from .common import bounded_batches, chunks, filled, slices, stash, text_bytes
from .words import find_sorted, split_words

#: Texts of a benchmark block, in bytes; its windows take about ten times as much.
BLOCK_BYTES = 4 << 20
#: Places that are intersected at once in a slice.
PLACES = 1 << 20
#: Slices in a row group of the stored index, and its bytes.
GROUP_ROWS, GROUP_BYTES = 32, 16 << 20

INDEX = "slice string, doc_ids array<long>, first array<int>, terms binary, sizes binary, places binary"
MATCHES = "doc_id long, item_id string, kind string, item_word long, doc_word long, n_words long"
HITS = "slice string, doc int, covered array<struct<a:int,b:int>>, items array<string>, near array<string>"


class Block:
    """Windows of some benchmark items, with their terms from the rarest. Terms are
    numbers in the sorted vocabulary."""

    def __init__(self, ids: list, texts: list[str], window: int):
        data = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        words = split_words(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
        self.vocabulary, term = np.unique(words.hash, return_inverse=True)
        n = np.diff(words.first)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        self.ids = [str(x) for x in ids]
        self.item = np.repeat(np.arange(len(n)), count)
        self.place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.size = size[self.item]
        width = int(size.max()) if len(n) else 0
        at = (words.first[:-1][self.item] + self.place)[:, None] + np.arange(width)[None, :]
        own = np.arange(width)[None, :] < self.size[:, None]
        self.terms = np.where(own, term[np.where(own, at, 0)] if len(term) else 0, -1).astype(np.int32)

    def order(self, counts: np.ndarray) -> None:
        """Given the corpus count of each term of the vocabulary."""
        df = np.where(self.terms >= 0, counts[self.terms] if len(counts) else 0, np.inf)
        self.places = np.argsort(df, axis=1, kind="stable").astype(np.int32)
        self.ranked = np.take_along_axis(self.terms, self.places, axis=1)


class Postings(NamedTuple):
    """The inverted words of some documents."""

    terms: np.ndarray  #: sorted
    at: np.ndarray  #: one more than terms: where each one's places begin
    places: np.ndarray  #: ascending for each term
    first: np.ndarray  #: one more than documents: the place of each one's first word


def invert(words) -> Postings:
    order = np.argsort(words.hash, kind="stable")
    terms = words.hash[order]
    new = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]][: len(terms)])
    return Postings(terms[new], np.r_[new, len(terms)], order, words.first)


def intersect(postings: Postings, block: Block, slop: int):
    """Exact matches (window, place) and, for a slop above 0, proximity matches (document,
    window, place where the window would begin, which can lie outside the document)."""
    none = np.zeros(0, np.int64)
    exact, near = [(none, none)], [(none, none, none)]
    n_places = len(postings.places)
    number = np.full(len(block.vocabulary) + 1, -1)  # -1 of the last for absent terms
    at, found = find_sorted(postings.terms, block.vocabulary)
    number[at] = found
    if not len(at):
        return *exact[0], *near[0]
    rarest = number[block.ranked[:, 0]]
    live = np.flatnonzero(rarest >= 0)
    low, high = postings.at[rarest[live]], postings.at[rarest[live] + 1]
    keys = np.repeat(np.arange(len(postings.terms)), np.diff(postings.at)) * n_places + postings.places

    def stand(term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is among the places of its term."""
        out = (term >= 0) & (place >= 0) & (place < n_places)
        wanted = term[out] * n_places + place[out]
        i = np.searchsorted(keys, wanted)
        out[out] = keys[np.minimum(i, n_places - 1)] == wanted
        return out

    ends = np.cumsum(high - low)
    i = 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PLACES, side="right")))
        n = high[i:j] - low[i:j]
        window = np.repeat(live[i:j], n)
        place = postings.places[np.repeat(low[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = place - block.places[window, 0]
        doc = np.searchsorted(postings.first, place, side="right") - 1
        begin, end = postings.first[doc], postings.first[doc + 1]
        whole = (start >= begin) & (start + block.size[window] <= end)
        w, s = window[whole], start[whole]
        for k in range(1, block.ranked.shape[1]):
            ok = (block.size[w] <= k) | stand(number[block.ranked[w, k]], s + block.places[w, k])
            w, s = w[ok], s[ok]
        exact.append((w, s))
        for k in (1, 2) if slop else ():
            ok = block.size[window] <= k
            if k < block.ranked.shape[1]:
                term, want = number[block.ranked[window, k]], start + block.places[window, k]
                for d in range(-slop, slop + 1):
                    ok |= (want + d >= begin) & (want + d < end) & stand(term, want + d)
            window, start, doc, begin, end = window[ok], start[ok], doc[ok], begin[ok], end[ok]
        if slop:
            near.append((doc, window, start))
        i = j
    return (*(np.concatenate(x) for x in zip(*exact, strict=True)), *(np.concatenate(x) for x in zip(*near, strict=True)))


# The stored index

def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        found = invert(split_words(*text_bytes(part.column(1))))
        data = [pa.array([x.tobytes()], pa.binary()) for x in (found.terms, np.diff(found.at).astype(np.int32), found.places.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([found.first.tolist()], pa.list_(pa.int32())), *data], names=["slice", "doc_ids", "first", "terms", "sizes", "places"])


def build_index(docs: DataFrame, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The stored postings of all words of ``docs``, a row for each slice of documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).mapInArrow(_invert, INDEX)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    # a reader holds a row group at once
    rows.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 4).option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _of_row(batch: pa.RecordBatch, i: int) -> Postings:
    terms, sizes, places = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("terms", np.uint64), ("sizes", np.int32), ("places", np.int32)))
    return Postings(terms, np.r_[0, np.cumsum(sizes, dtype=np.int64)], places.astype(np.int64), np.array(batch.column("first")[i].as_py(), dtype=np.int64))


def _sum_terms(vocabulary: Broadcast):
    """How many places the terms of a vocabulary have in the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), dtype=np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column("terms"), batch.column("sizes"), strict=True):
                at, found = find_sorted(np.frombuffer(terms.as_buffer(), dtype=np.uint64), vocabulary.value)
                total[at] += np.frombuffer(sizes.as_buffer(), dtype=np.int32)[found]
        yield _counts(total)

    return run


def _sum_words(vocabulary: Broadcast):
    """The same from texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), dtype=np.int64)
        for part in chunks(batches, "text"):
            _, found = find_sorted(vocabulary.value, split_words(*text_bytes(part.column(0))).hash)
            total += np.bincount(found, minlength=len(total))
        yield _counts(total)

    return run


def _counts(total: np.ndarray) -> pa.RecordBatch:
    seen = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["term", "n"])


def term_counts(rows: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each term in the rows, which are an index or have a column ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    one = rows.select("text").mapInArrow(_sum_words(shared), "term long, n long") if "text" in rows.columns else rows.select("terms", "sizes").mapInArrow(_sum_terms(shared), "term long, n long")
    out = np.zeros(len(vocabulary), dtype=np.float64)
    for r in one.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of a block at most
        out[r["term"]] = r["n"]
    shared.unpersist()
    return out


# Searching

def blocks_of(benchmark: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[Block, bool]]:
    """The benchmark's windows in blocks of about ``block_bytes`` of text, and whether it
    is the only one. No more than one block is on the driver."""
    usable = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    n = max(1, -(-(usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for i in range(n):
        part = usable if n == 1 else usable.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)
        rows = part.collect()
        yield Block([r["id"] for r in rows], [r["text"] for r in rows], window), n == 1


def _each_block(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, item_id: str, item_text: str, search, schema: str) -> DataFrame:
    """What a search gives for all blocks, block by block."""
    out = None
    for block, only in blocks_of(benchmark, window, item_id, item_text, block_bytes):
        block.order(term_counts(rows, block.vocabulary))
        shared = rows.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(search(shared), schema)
        if only:
            return found
        found = stash(found)
        shared.unpersist()
        out = found if out is None else out.union(found)
    return out


def _covered(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals that are sorted by start."""
    end = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.r_[new[1:], len(end)] - 1].tolist(), strict=True))


def _hits(shared: Broadcast, slop: int):
    """A row for each document with matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            rows = []
            for i, name in enumerate(batch.column("slice").to_pylist()):
                postings = _of_row(batch, i)
                w, s, near_doc, near_window, _ = intersect(postings, block, slop)
                doc = np.searchsorted(postings.first, s, side="right") - 1
                items: dict[int, set] = {}
                close: dict[int, set] = {}
                for out, docs, windows in ((items, doc, w), (close, near_doc, near_window)):
                    for d, k in set(zip(docs.tolist(), block.item[windows].tolist(), strict=True)):
                        out.setdefault(d, set()).add(block.ids[k])
                order = np.lexsort((s, doc))
                w, s, doc = w[order], s[order] - postings.first[doc[order]], doc[order]
                for d in sorted({*items, *close}):
                    own = slice(*np.searchsorted(doc, [d, d + 1]))
                    covered = [{"a": a, "b": b} for a, b in _covered(s[own], s[own] + block.size[w[own]])] if d in items else []
                    rows.append((name, d, covered, sorted(items.get(d, ())), sorted(close.get(d, ()))))
            kinds = [pa.string(), pa.int32(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.string())]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["slice", "doc", "covered", "items", "near"])

    return run


def _places(shared: Broadcast, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            for i, ids in enumerate(batch.column("doc_ids").to_pylist()):
                postings = _of_row(batch, i)
                w, s, near_doc, near_window, near_start = intersect(postings, block, slop)
                exact, close = set(), set()
                for out, doc, window, start in ((exact, np.searchsorted(postings.first, s, side="right") - 1, w, s), (close, near_doc, near_window, near_start)):
                    values = (doc, block.item[window], block.place[window], start - postings.first[doc], block.size[window])
                    out.update((d, block.ids[k], *rest) for d, k, *rest in zip(*[v.tolist() for v in values], strict=True))
                hit = {x[:2] for x in exact}
                rows = [(ids[x[0]], x[1], kind, *x[2:]) for kind, out in (("exact", exact), ("near", {x for x in close if x[:2] not in hit})) for x in sorted(out)]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "kind", "item_word", "doc_word", "n_words"])

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 3, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per match of a window, ``exact`` or ``near``: the item, the window's first
    word in it, and the word of the document where the window begins, or would begin
    beside its rarest term. Items with an exact match have no near ones in a document."""
    index = build_index(docs, doc_id, doc_text)
    return _each_block(index, benchmark, window, block_bytes, item_id, item_text, lambda b: _places(b, slop), MATCHES)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 3, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every
    document: its words, those inside benchmark windows, the items with exact matches, and
    how many others have proximity matches."""
    index = build_index(docs, doc_id, doc_text)
    hits = _each_block(index, benchmark, window, block_bytes, item_id, item_text, lambda b: _hits(b, slop), HITS)
    key = ["slice", "doc"]
    # a document's lists are no longer than it and the benchmark are
    lists = [F.array_sort(F.flatten(F.collect_list("covered"))).alias("covered"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near"))]
    found = hits.groupBy(*key).agg(*lists)
    ends = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["b"]).alias("at"), (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["at"]), F.lit(0))).alias("n"))
    found = found.select(*key, F.aggregate("covered", ends, step, lambda s: s["n"]).alias("hit"), F.size("items").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("sha"), F.size(F.array_except("near", "items")).alias("close"))
    each = index.select("slice", F.posexplode(F.arrays_zip(F.col("doc_ids").alias("id"), F.slice("first", 1, F.size("doc_ids")).alias("a"), F.slice("first", 2, F.size("doc_ids")).alias("b"))).alias("doc", "x"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias
    all_docs = each.join(found, key, "left")
    return all_docs.select(F.col("x.id").alias("doc_id"), (F.col("x.b") - F.col("x.a")).cast("long").alias("n_words"), count("hit")("n_hit"), count("k")("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"), count("close")("n_near"))


def _clean(shared: Broadcast, column: str):
    """Rows without an exact match, as they came. Each slice is inverted where it stands:
    its postings are needed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, column):
            part = filled(rows, column)
            postings = invert(split_words(*text_bytes(part.column(part.schema.get_field_index(column)))))
            _, s, *_ = intersect(postings, shared.value, 0)
            keep = np.ones(part.num_rows, dtype=bool)
            keep[np.searchsorted(postings.first, s, side="right") - 1] = False
            yield rows.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any benchmark window, all columns as they came."""
    bounded_batches(docs.sparkSession)
    for block, only in blocks_of(benchmark, window, item_id, item_text, block_bytes):
        block.order(term_counts(docs.select(F.col(doc_text).alias("text")), block.vocabulary))
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), doc_text), docs.schema)
        if not only:
            docs = stash(docs)
    return docs
