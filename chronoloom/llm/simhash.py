"""SimHash near duplicates over a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two that differ in two bits at most share six of
them or more, so some two of the four byte pairs agree: the index posts each fingerprint
under the six combinations of two byte pairs, four positional bytes in all, and linked
fingerprints meet in a posting list. For each pair of a list the shared positional bytes
are tallied; pairs with fewer than the guaranteed six are discarded, the bits of the
others are compared. Of the links a list gives no more than it has rows, as only
components are asked for.

A posting list of more than ``LONG_LIST`` fingerprints is split: two more of its four
open bytes have to agree, which gives six lists of six positional bytes each. Such a list
holds 2**16 fingerprints at most, its pairs all reach the count, and each of its
fingerprints is looked up with one and two of the 16 open bits changed, so that a family
of near copies gives no pair for each two of its members. No link is lost in either way.

Copies are one fingerprint in the index; what is counted or joined for all documents of
one is aggregated before the shuffle or broadcast.

Defined results: null and empty texts and texts without words have the fingerprint zero,
which links like any other; with fewer than three words the whole sequence is the only
shingle; repeated shingles count as often as they stand; rows with a null id have a
fingerprint and link with nothing, their component is null; rows that repeat an id share
the smallest component of its texts; an empty table gives no rows; further columns are
ignored; very long texts are read whole, their hashes counted in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, stash, text_bytes
from .graph import components
from .runs import run_pairs, whole_runs
from .words import LOWER, NOT_SPACE

SEED = 42
#: Posting lists with more fingerprints are split by two more bytes.
LONG_LIST = 512
#: Hashes, and pairs, that are worked on at once.
HASHES, PAIRS = 1 << 16, 1 << 20
#: Guaranteed number of shared positional bytes, and bits that may differ.
SHARED, BITS = 6, 2


def _shingles(part: pa.RecordBatch, n: int):
    """The words of all texts joined by single spaces, and the places of each shingle in
    that; offsets of each text's shingles."""
    raw, offsets = text_bytes(part.column(1))
    low = LOWER[raw]
    word = NOT_SPACE[low]
    before = np.r_[False, word[:-1]] if len(word) else word
    before = before.copy()
    cut = offsets[:-1]
    before[cut[cut < len(word)]] = False
    start = np.flatnonzero(word & ~before)
    first = np.searchsorted(start, offsets)
    at = np.cumsum(word) - word  # place of a byte among the words' bytes
    begin = at[start] if len(start) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, int(word.sum())])
    data = np.insert(low[word], begin[1:], 32).tobytes() if len(start) else b""
    begin = begin + np.arange(len(begin))
    end = begin + size
    count = np.diff(first)
    per_doc = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    own = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(len(count)), per_doc)
    head = first[:-1][doc] + np.arange(own[-1]) - own[doc]
    tail = np.minimum(head + n, first[1:][doc]) - 1
    return data, begin[head], end[tail], own


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for part in chunks(batches, "text"):
            data, begin, end, own = _shingles(part, n)
            size = np.diff(own)
            ones = np.zeros((part.num_rows, 64), dtype=np.int64)
            for i in range(0, int(own[-1]), HASHES):
                j = min(i + HASHES, int(own[-1]))
                h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True)), dtype=np.uint64, count=j - i)
                bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                docs = np.arange(np.searchsorted(own, i, side="right") - 1, np.searchsorted(own, j, side="left"))
                docs = docs[size[docs] > 0]
                ones[docs] += np.add.reduceat(bits, np.maximum(own[docs] - i, 0), axis=0, dtype=np.int64)
            bits = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.ascontiguousarray(bits).view("<i8").reshape(-1))], names=["doc_id", "fp"])

    return run


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected with by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, label[i], low)
        np.minimum.at(now, label[j], low)
        now = now[now]
        if (now == label).all():
            break
        label = now
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def _links(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    label = _least(len(fp), i, j)
    own = np.flatnonzero(label != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[label[own]].view(np.int64)), pa.array(fp[own].view(np.int64))], names=["a", "b"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of short posting lists: shared bytes are tallied, then bits compared."""
    for table, at in whole_runs(batches, ["positions", "posted"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in run_pairs(at, PAIRS):
            differ = fp[i] ^ fp[j]
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            kept = np.flatnonzero(shared >= SHARED)
            kept = kept[np.bitwise_count(differ[kept]) <= BITS]
            left.append(i[kept])
            right.append(j[kept])
        yield _links(fp, np.concatenate(left), np.concatenate(right))


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of lists in which six bytes agree: at most 2**16 fingerprints, which are
    looked up by what is in the two open bytes."""
    masks = [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)]
    row_of = np.full(1 << 16, -1, dtype=np.int64)
    for table, at in whole_runs(batches, ["positions", "posted"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        open_ = table.column("open").to_numpy()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            own = open_[s:e]
            row_of[own] = np.arange(s, e)
            for mask in masks:
                other = row_of[own ^ mask]
                found = np.flatnonzero(other >= 0)
                found = found[other[found] > found + s]
                left.append(found + s)
                right.append(other[found])
            row_of[own] = -1
        yield _links(fp, np.concatenate(left), np.concatenate(right))


def _byte(position: int) -> str:
    return f"(shiftrightunsigned(fp, {8 * position}) & 255)"


def _posts(width: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every pair that shares six has one in common."""
    pairs = [(0, 1), (2, 3), (4, 5), (6, 7)]
    if width == 4:
        return [a + b for a, b in combinations(pairs, 2)]
    return list(combinations(range(8), width))


def _packed(positions: tuple[int, ...]) -> str:
    return "(" + " | ".join(f"shiftleft({_byte(p)}, {8 * i})" for i, p in enumerate(positions)) + ")"


def _split(long_lists: DataFrame) -> DataFrame:
    """Rows of long lists under each two more of their open bytes: six positions and the
    bytes there, and what stands in the two that stay open."""
    out = []
    for four in _posts(4):
        free = [p for p in range(8) if p not in four]
        for two in combinations(free, 2):
            six = tuple(sorted(four + two))
            rest = tuple(p for p in free if p not in two)
            where = sum(1 << p for p in four)
            out.append(f"struct({where} as was, {sum(1 << p for p in six)} as positions, {_packed(six)} as posted, cast({_packed(rest)} as int) as open)")
    split = long_lists.select("fp", F.col("positions").alias("from"), F.explode(F.expr(f"filter(array({', '.join(out)}), x -> x.was = positions)")).alias("x"))
    # one of the lists that two long ones with the same six bytes would give
    return split.select("fp", "x.positions", "x.posted", "x.open").distinct()


def links_between(prints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): links of the distinct fingerprints ``fp`` from which all components follow."""
    bounded_batches(prints.sparkSession)
    posts = [f"struct({sum(1 << p for p in four)} as positions, {_packed(four)} as posted)" for four in _posts(4)]
    index = prints.select("fp", F.explode(F.expr(f"array({', '.join(posts)})")).alias("x")).select("fp", "x.positions", "x.posted")
    key = ["positions", "posted"]
    sizes = stash(index.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"))
    held = stash(index.join(sizes, key))
    out = "a long, b long"
    links = held.where(F.col("size") <= long_list).select("fp", *key).repartition(*key).sortWithinPartitions(*key).mapInArrow(_tally, out)
    if not sizes.where(F.col("size") > long_list).isEmpty():
        wide = _split(held.where(F.col("size") > long_list))
        links = links.union(wide.repartition(*key).sortWithinPartitions(*key).mapInArrow(_dense, out))
    return links


def near_copies(docs: DataFrame, n: int = 3, long_list: int = LONG_LIST, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    rows = stash(texts.mapInArrow(_fingerprints(n), "doc_id long, fp long"))
    classes = stash(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    found = links_between(classes.select("fp"), long_list)
    # an id with several texts joins their fingerprints
    many = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).where("a != hi").select("doc_id", "a")
    found = found.union(rows.join(many, "doc_id").select("a", F.col("fp").alias("b")))
    linked = stash(components(found))
    lowest = linked.join(classes, linked.node == classes.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    placed = linked.join(lowest, "component").select(F.col("node").alias("fp"), "component_id")
    known = stash(classes.join(placed, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id")))
    # fingerprints with a thousandth of all rows each: a thousand at most, which need no shuffle
    frequent = F.col("copies") >= max(100, rows.count() / 1000)
    large = F.broadcast(known.where(frequent).select("fp", "component_id"))
    others = rows.join(large, "fp", "left_anti").join(known.where(~frequent).select("fp", "component_id"), "fp", "left")
    every = rows.join(large, "fp").unionByName(others)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
