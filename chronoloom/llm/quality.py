"""A quality classifier: a generalised additive model with pairwise interactions.

Texts become a few numeric features. Each feature is binned; boosting goes through the
features in a cycle, fits a shallow tree of a few splits to the current gradients over
that feature's bins and adds it to the feature's lookup table. The pairs of features
with the largest remaining gain get two-dimensional tables in the same way. A score is
the logistic function of the sum of the looked-up table entries.

The model is fitted on at most ``sample`` labelled ids (labelled.SAMPLE), one row for
each, so fitting does not grow with the corpus; all rows are scored in parallel. Labels, language,
source and ids are no features.

Defined results: null and empty texts have all-zero features and are scored like other
texts; without usable labels every score is 0.5; of rows that repeat a labelled id the
smallest text is learned from; a feature level with a bin's edge falls into the upper bin;
repeated rows repeat scores; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, text_bytes
from .labelled import SAMPLE, remainder, training_ids
from .words import NOT_SPACE, split_words

FEATURES = ["words", "word_bytes", "upper", "digit", "bang", "symbol", "space", "line_words", "non_ascii", "distinct", "repeat", "short", "long", "pipe", "stop", "distinct_lines", "comma", "upper_words"]
_NEWLINE = np.ones(256, dtype=bool)
_NEWLINE[10] = False


def _mask(*ranges) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH = _mask((65, 90)), _mask((97, 122)), _mask((48, 57)), _mask((9, 13), (32, 32)), _mask((128, 255))
_SYMBOL = _mask((35, 38), (42, 43), (60, 64), (91, 96), (123, 126))


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    def distinct(found) -> np.ndarray:
        pairs = np.unique(np.stack([found.doc.astype(np.uint64), found.hash], axis=1), axis=0) if len(found.hash) < 2 else _distinct_pairs(found.doc, found.hash)
        return np.bincount(pairs if pairs.ndim == 1 else pairs[:, 0].astype(np.int64), minlength=n).astype(np.float64)

    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    words = split_words(raw, offsets, NOT_SPACE)
    n_words = np.diff(words.first).astype(np.float64)
    some = np.maximum(n_words, 1)
    length = words.end - words.start
    by_doc = lambda x: np.bincount(words.doc, weights=x, minlength=n)
    upper, lower = count(_UPPER[raw]), count(_LOWER[raw])
    lines = split_words(raw, offsets, _NEWLINE)
    n_lines = np.maximum(np.diff(lines.first), 1)
    same = np.zeros(len(words.hash), dtype=bool)
    if len(same) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    capital = _UPPER[raw[words.end - 1]] | _UPPER[raw[np.maximum(words.end - 2, words.start)]] if len(words.hash) else np.zeros(0, bool)
    columns = [np.log1p(n_words), by_doc(length) / some, upper / np.maximum(upper + lower, 1), count(_DIGIT[raw]) / size, count(raw == 33) / some, count(_SYMBOL[raw]) / size, count(_SPACE[raw]) / size, n_words / n_lines, count(_HIGH[raw]) / size, distinct(words) / some, by_doc(same) / some, by_doc(length <= 2) / some, by_doc(length >= 14) / some, count(raw == 124) / some, count(raw == 46) / some, distinct(lines) / n_lines, count(raw == 44) / some, by_doc(capital & (length > 2)) / some]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(FEATURES)))


def _distinct_pairs(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The document of each distinct (document, value)."""
    key = value ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    return doc[at]


class Additive:
    """Lookup tables over bins, for single features and for pairs."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, splits: int = 3, least: float = 20.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.splits, self.least = bins, coarse, rounds, pair_rounds, pairs, rate, splits, least
        self.base, self.pairs = 0.0, []
        self.edges = self.coarse_edges = self.tables = self.pair_tables = None

    def _edges(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1)

    def _shallow(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of a few splits over ordered bins: a step for each bin."""
        cuts = [0, len(g)]
        gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
        for _ in range(self.splits):
            best = (1e-9, None)
            for a, b in zip(cuts, cuts[1:], strict=False):
                mid = np.arange(a + 1, b)
                if not len(mid):
                    continue
                gl, hl, gr, hr = gs[mid] - gs[a], hs[mid] - hs[a], gs[b] - gs[mid], hs[b] - hs[mid]
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1)
                gain[(hl < self.least / 4) | (hr < self.least / 4)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], int(mid[i]))
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.empty(len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1)
        return out

    def _square(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One split of the first feature, one of the second in each half."""
        best = (-1.0, 1)
        for i in range(1, g.shape[0]):
            score = sum(self._halves(g[p].sum(0), h[p].sum(0))[0] for p in (slice(0, i), slice(i, None)))
            best = max(best, (score, i))
        out = np.zeros_like(g)
        for p in (slice(0, best[1]), slice(best[1], None)):
            out[p] = self._halves(g[p].sum(0), h[p].sum(0))[1][None, :]
        return out

    @staticmethod
    def _halves(g: np.ndarray, h: np.ndarray):
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
        i = int(np.argmax(gain))
        step = np.empty(len(g))
        step[: i + 1], step[i + 1 :] = gl[i] / (hl[i] + 1), (g.sum() - gl[i]) / (h.sum() - hl[i] + 1)
        return gain[i], step

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        x = x if len(x) else np.zeros((1, len(FEATURES)))
        self.edges, self.coarse_edges = self._edges(x, self.bins), self._edges(x, self.coarse)
        k = x.shape[1]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables = []
        if len(y) < 2 or y.min() == y.max():
            return self
        at, rough = self._binned(x, self.edges), self._binned(x, self.coarse_edges)
        margin = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-margin))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f in range(k):
                g, h = slopes()
                size = len(self.tables[f])
                step = self.rate * self._shallow(np.bincount(at[:, f], g, size), np.bincount(at[:, f], h, size))
                self.tables[f] += step
                margin += step[at[:, f]]
        g, h = slopes()
        wide = [len(e) + 1 for e in self.coarse_edges]
        sums = lambda i, j, v: np.bincount(rough[:, i] * wide[j] + rough[:, j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])
        usable = [(i, j) for i in range(k) for j in range(i) if wide[i] > 1 and wide[j] > 1]
        gains = sorted(((float((sums(i, j, g) ** 2 / (sums(i, j, h) + 1)).sum()), i, j) for i, j in usable), reverse=True)
        self.pairs = [(i, j) for _, i, j in gains[: self.n_pairs]]
        self.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for t, (i, j) in enumerate(self.pairs):
                g, h = slopes()
                step = self.rate * self._square(sums(i, j, g), sums(i, j, h))
                self.pair_tables[t] += step
                margin += step[rough[:, i], rough[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        at, rough = self._binned(x, self.edges), self._binned(x, self.coarse_edges)
        margin = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            margin += table[at[:, f]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            margin += table[rough[:, i], rough[:, j]]
        return 1 / (1 + np.exp(-margin))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        x = text_features(*text_bytes(part.column(1)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["doc_id", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Additive:
    """The model, from at most ``sample`` labelled rows: their features, a few numbers
    each, come to the driver."""
    bounded_batches(docs.sparkSession)
    chosen = training_ids(labels, label, mod, held_out, sample)
    # one row for each id, so that repeated ids leave the bound as it is
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    known = rows.mapInArrow(_features, "doc_id long, x array<double>").join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "label").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(known["x"].tolist(), dtype=np.float64).reshape(len(known), len(FEATURES))
    return Additive().fit(x, known["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held_out: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(texts, labels, label, mod, held_out, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(text_features(*text_bytes(part.column(1)))))], names=["doc_id", "score"])

    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
