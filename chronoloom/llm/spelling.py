"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Runs of letters are counted over all texts, summed by task before the shuffle. Of two
words one edit apart, the common prefix and the common suffix together reach the longer
length less one, so one of them covers half of the shorter word. Words are therefore
blocked by half prefixes and half suffixes, for each length with the next one. A block of
more than ``block`` words is halved again: either the next half of what is still open
agrees, or the last one, down to blocks whose words have one open code point at most,
which no alphabet makes large. A near pair of a block passes to just one of the two halves
(to the prefix half if its common prefix reaches that far), so it is found once.

Inside a block the words are rows of padded code-point matrices, one aligned at the start
and one at the end; the common prefix and suffix lengths of all pairs of rows come from
comparing these rows. What leaves a task is a count and the best near word for each word
and block, no pairs.

A word's form is its near word of largest count if that is twice the word's own, and its
root is where forms lead, found by pointer doubling.

Defined results: null and empty texts have no runs; a null id counts as an empty text
before the colon; rows that repeat an id and a text count each time; of near words with
equal counts the first in code-point order is the form; an empty table gives no rows;
further columns are ignored; very long texts are read whole, and very long runs are words
like others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, stash, text_bytes
from .runs import run_pairs, whole_runs
from .words import LOWER

#: Words of a block at most, and code points of its matrix.
BLOCK, CELLS = 1024, 1 << 22
#: Words that a task counts before it passes the counts on.
HELD = 200_000
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_KEY = ["m", "a", "b", "cap", "part"]


def _counts(every: int, shortest: int):
    """(word, n) of a task's texts, in which one of ``every`` runs loses a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in chunks(batches, "text"):
            raw, offsets = text_bytes(part.column(1))
            low = LOWER[raw].tobytes()
            ids = part.column(0).to_pylist()
            for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                seed = crc32(f"{'' if ids[i] is None else ids[i]}:".encode())
                # a run of fewer code points, which are no more than its bytes, is no word
                found = [w for w in _LETTERS.findall(low, s, e) if len(w) >= shortest]
                for j in np.flatnonzero(np.fromiter((crc32(w, seed) for w in found), np.int64, len(found)) % every == 0).tolist():
                    h, word = crc32(found[j], seed), found[j].decode()
                    at = h % len(word)
                    found[j] = (word[:at] + word[at + 1 :]).encode()
                held.update(found)
                if len(held) > HELD:
                    yield _flushed(held)
                    held = Counter()
        yield _flushed(held)

    return run


def _flushed(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def count_words(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(word, n): words of at least ``shortest`` code points with their counts over all
    texts, those below ``least`` left out."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(doc_text).alias("text"))
    counts = texts.mapInArrow(_counts(every, shortest), "word string, n long").where(F.char_length("word") >= shortest)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row under the two halves of what its block leaves open."""
    half = "((m - a - b) div 2)"
    after = f"array(struct(a + {half} as a, b, cap), struct(a, b + {half} as b, least(cap, a + {half}) as cap))"
    cut = rows.select("word", "n", "size", "m", F.explode(F.expr(after)).alias("x")).select("word", "n", "size", "m", "x.a", "x.b", "x.cap")
    return cut.withColumn("part", F.expr("xxhash64(left(word, a), right(word, b))"))


def _blocks(words: DataFrame, shortest: int, block: int) -> DataFrame:
    """Words under the keys of blocks that hold two or more of them and are small enough."""
    size = F.char_length("word")
    whole = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= shortest)
    rows = _halved(whole.select("*", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("m") + 1).alias("cap")))
    most = F.greatest(F.lit(2), F.least(F.lit(block), (F.lit(CELLS) / F.col("m")).cast("int")))
    done = None
    while True:
        rows = stash(rows)
        sizes = stash(rows.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.min("size").alias("lo")).where("rows > 1 and lo = m"))
        large = (F.col("rows") > most) & F.expr("m - a - b >= 2")
        small = rows.join(sizes.where(~large).select(*_KEY), _KEY)
        done = small if done is None else done.unionByName(small)
        if sizes.where(large).isEmpty():
            return done
        rows = _halved(rows.join(sizes.where(large).select(*_KEY), _KEY))


def _matrices(words: list[str], width: int):
    """Code points of words as rows, from the start and from the end, padded with zeros."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    inside = np.arange(width)[None, :] < size[:, None]
    left = np.zeros((len(words), width), dtype=np.uint32)
    right = np.zeros((len(words), width), dtype=np.uint32)
    left[inside] = flat
    row, place = np.nonzero(inside)
    right[row, size[row] - 1 - place] = flat
    return left, right, size


def _agreeing(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far rows i and j agree from their first entry on."""
    differ = rows[i] != rows[j]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def near_pairs(words: list[str], m: int, cap: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block that are one edit apart, one of them of length m, and
    whose common prefix is shorter than the block's cap."""
    left, right, size = _matrices(words, m + 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in run_pairs(at, max(1, CELLS // (m + 1))):
        fit = (size[i] == m) | (size[j] == m)
        i, j = i[fit], j[fit]
        longer, shorter = np.maximum(size[i], size[j]), np.minimum(size[i], size[j])
        prefix = np.minimum(_agreeing(left, i, j), shorter)
        suffix = np.minimum(_agreeing(right, i, j), shorter)
        near = (prefix + suffix >= longer - 1) & (prefix < cap[i])
        out.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of each block's words that have near words in it."""
    for table, at in whole_runs(batches, _KEY):
        lengths, caps, counts = (table.column(c).to_numpy() for c in ("m", "cap", "n"))
        every = table.column("word")
        first = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(lengths)], strict=True):
            m = int(lengths[s])
            # blocks of one length, as many as the matrices' size allows
            ends = at[(at > s) & (at <= e)]
            while s < e:
                stop = max(int(ends[np.searchsorted(ends, s, side="right")]), int(ends[max(0, np.searchsorted(ends, s + CELLS // (m + 1), side="right") - 1)]))
                words = every.slice(s, stop - s).to_pylist()
                i, j = near_pairs(words, m, caps[s:stop], np.r_[s, ends[(ends > s) & (ends <= stop)]] - s)
                yield _best(words, counts[s:stop], np.r_[i, j], np.r_[j, i])
                s = stop


def _best(words: list[str], n: np.ndarray, row: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[partner], -n[partner], row))
    row, partner = row[order], partner[order]
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    near = np.diff(np.r_[new, len(row)])
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in row[new]], pa.string()), pa.array(near.astype(np.int64)), pa.array(n[partner[new]].astype(np.int64)), pa.array([words[i] for i in partner[new]], pa.string())], names=["word", "n_near", "best_n", "best"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: where forms lead in the end. A form has twice
    the count at least, so chains are short, and each round doubles the step."""
    to = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stash(to.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        to = stash(stepped.select("word", "root"), replaces=stepped)


def spelling_variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, times: int = 2, block: int = BLOCK, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(word, n, form, form_n, root, n_near) for every counted word."""
    words = stash(count_words(docs, every, shortest, least, doc_id, doc_text))
    dealt = _blocks(words, shortest, block).repartition(*_KEY).sortWithinPartitions(*_KEY)
    found = dealt.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("x"))
    twice = -F.col("x.least") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(twice, F.col("x.best")).alias("form"), F.when(twice, -F.col("x.least")).alias("form_n"))
    rows = stash(rows)
    root = _roots(rows.where("form is not null"))
    return rows.join(root, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
