"""Toxicity scores with noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Tokens that may be written
over become a lattice of readings: a digit or sign may stand for letters, a letter that
repeats the one before it or a separator may be dropped, each at a channel cost. Viterbi
decoding under the trigram model, over all states, gives the restored token, which is
scored along with the text's own words.

Into the lattice go: tokens with a digit or sign beside a letter, letters drawn out
three times or more, single letters set apart by signs or spaces, and runs of up to
three letters set apart by signs. A letter that stands twice is compared with the same
letter once by the model's own figures, which for a doubling between other letters is
what the lattice would give; tokens where once is likelier go through the lattice.

Scores: words and word beginnings that stand out in toxic training texts carry a
log-likelihood ratio; a logistic model over a text's sums of these gives its score.
Both are learned on at most ``sample`` labelled ids (labelled.SAMPLE), one row for each,
so that part does not grow with the corpus; all features of these rows with at least
``least_ratio`` are kept. Labels, language, source and ids are no inputs.

Defined results: null and empty texts have no words and get the score of such texts;
without usable labels every score is 0; of rows that repeat a labelled id the smallest
text is learned from; of equally good readings the first in the order of states counts;
repeated rows repeat scores; an empty table gives no rows; further columns are ignored by
``score_toxicity`` and kept by ``without_toxic``; whole texts are read, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, filled, slices, stash, text_bytes
from .labelled import SAMPLE, remainder, training_ids
from .words import ALNUM, NOT_SPACE, find_sorted, mix, span_hash, split_words

# What digits and signs may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "€": "e", "(": "c"}
SEPARATORS = " .-_*'~"

#: Word beginnings of these many bytes are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8, 10)
_LETTERS = 28  # boundary, a to z, anything else
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27

_LETTER = (_SYMBOL > 0) & (_SYMBOL < 27)
#: Digits and signs before a letter, and those that count after one too.
_SIGN, _FIRM_SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
_FIRM_SIGN[[ord(c) for c in "0123456789@$"]] = True
#: Channel costs: a sign for a letter, a separator or a letter drawn out that is dropped,
#: and a letter that stands twice and is dropped.
SWAP, DROP, TWICE = 0.7, 1.0, 1.5

_APART = re.compile(r"(?<![^\W_])[a-z0-9@$!|](?:[ .\-_*'~]{1,3}[a-z0-9@$!|]){2,}(?![^\W_])")
_PIECES = re.compile(r"(?<![^\W_])[a-z0-9@$!|]{1,3}(?:[.\-_*'~]{1,3}[a-z0-9@$!|]{1,3}){2,}(?![^\W_])")
_WORDS = re.compile(r"[a-z]+")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_LETTERS**3, dtype=np.int64)
    for part in chunks(batches, "text"):
        s = _SYMBOL[text_bytes(part.column(0))[0]]
        if len(s) > 2:
            total += np.bincount((s[:-2] * _LETTERS + s[1:-1]) * _LETTERS + s[2:], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])


def trigram_model(texts: DataFrame) -> np.ndarray:
    """Log-probabilities of a symbol after two others, from counts over all texts. The
    table has 28 ** 3 entries whatever the corpus."""
    rows = texts.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_LETTERS**3)
    for r in rows:
        counts[r["code"]] = r["n"]
    counts = counts.reshape((_LETTERS,) * 3)
    pairs = counts.sum(0) + 0.5
    back = pairs / pairs.sum(1, keepdims=True)
    return np.log((counts + 20 * back[None]) / (counts.sum(2, keepdims=True) + 20))


class Decoder:
    """Viterbi decoding of written-over tokens; the last tokens' readings are kept."""

    def __init__(self, model: np.ndarray, kept: int = 50_000):
        self.model, self.log = model, model.tolist()
        self.kept, self.seen = kept, {}

    @staticmethod
    def readings(c: str, before: str, around: str = "") -> list[tuple[int | None, str, float]]:
        """(symbol or None for nothing, letter, cost) of a character after another;
        ``around``: the one two before and the next."""
        out = []
        if "a" <= c <= "z":
            out.append((ord(c) - 96, c, 0.0))
            if c == before:
                out.append((None, "", DROP if c in around else TWICE))
        for x in LEET.get(c, ""):
            out.append((ord(x) - 96, x, SWAP))
        if c in SEPARATORS:
            out.append((None, "", DROP))
        return out or [(27, c, 0.0)]

    def decode(self, token: str) -> str:
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > self.kept:
                self.seen.clear()
            got = self.seen[token] = self._viterbi(token)
        return got

    def _viterbi(self, token: str) -> str:
        # back pointers, not strings, so that long tokens cost time in proportion
        states = {(0, 0): (0.0, None)}
        before = ""
        for i, c in enumerate(token):
            options = self.readings(c, before, token[max(0, i - 2) : max(0, i - 1)] + token[i + 1 : i + 2] if c == before else "")
            before = c
            after: dict = {}
            for (a, b), (score, path) in states.items():
                row = self.log[a][b]
                for symbol, letter, cost in options:
                    if symbol is None:
                        key, value, step = (a, b), score - cost, path
                    else:
                        key, value, step = (b, symbol), score - cost + row[symbol], (path, letter)
                    if key not in after or value > after[key][0]:
                        after[key] = (value, step)
            states = after
        path, best = None, -np.inf
        for (a, b), (score, own) in states.items():
            if score + self.log[a][b][0] > best:
                path, best = own, score + self.log[a][b][0]
        letters = []
        while path is not None:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def _suspect(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes that bring their token into the lattice."""
        s = _SYMBOL[raw]
        letter, sign, firm = _LETTER[raw], _SIGN[raw], _FIRM_SIGN[raw]
        hit = np.zeros(len(raw), dtype=bool)
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        same = ~edge[1 : len(raw)]  # this byte and the next are of one text
        hit[:-1] |= sign[:-1] & letter[1:] & same
        hit[1:] |= firm[1:] & letter[:-1] & same
        hit[:-2] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x82) & (raw[2:] == 0xAC)
        twice = np.flatnonzero(letter[:-1] & (s[:-1] == s[1:]) & same)
        if len(twice):
            around = np.r_[0, s, 0, 0]
            v, x, w = around[twice], around[twice + 1], around[twice + 3]
            v, w = np.where(edge[twice], 0, v), np.where(edge[twice + 2], 0, w)
            m = self.model
            hit[twice] |= (v == x) | (m[v, x, w] - TWICE > m[v, x, x] + m[x, x, w])
        return np.flatnonzero(hit)

    def restored_of(self, texts: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str]]:
        """(text, restored word) of the written-over tokens of a batch."""
        out = []
        at = self._suspect(raw, offsets) if len(raw) else np.zeros(0, np.int64)
        if len(at):
            cuts = np.flatnonzero(~NOT_SPACE[raw])
            doc = np.searchsorted(offsets, at, side="right") - 1
            k = np.searchsorted(cuts, at)
            start = np.maximum(np.r_[-1, cuts][k] + 1, offsets[doc])
            end = np.minimum(np.r_[cuts, len(raw)][k], offsets[doc + 1])
            start, own = np.unique(start, return_index=True)
            for d, a, b in zip(doc[own].tolist(), start.tolist(), end[own].tolist(), strict=True):
                token = raw[a:b].tobytes().decode("utf-8", "replace").lower()
                out += [(d, w) for w in self.words(token)]
        for d, text in enumerate(texts.to_pylist()):
            low = text.lower()
            apart = {m[0] for m in _APART.finditer(low)} | {m[0] for m in _PIECES.finditer(low)}
            for token in sorted(apart):
                if sum("a" <= c <= "z" for c in token) > 1:
                    out += [(d, w) for w in self.words(token)]
        return out

    def words(self, token: str) -> list[str]:
        token = token.strip("()[]{}\"',.;:?#%&").rstrip("!*|+")
        return [w for w in _WORDS.findall(self.decode(token)) if len(w) > 2]

    def restored(self, text: str) -> list[str]:
        """Restored forms of the written-over tokens of a text."""
        column = pa.array([text], pa.string())
        return [w for _, w in self.restored_of(column, *text_bytes(column))]


def _terms(raw: np.ndarray, offsets: np.ndarray):
    """(document, word, features) of all words: a row of feature hashes for each word,
    zero where the word is shorter than the beginning asked for."""
    words = split_words(raw, offsets, ALNUM)
    rows = [words.hash]
    for k in PREFIXES:
        ok = words.end - words.start > k
        own = np.zeros(len(words.hash), dtype=np.uint64)
        own[ok] = mix(span_hash(words.sums, words.start[ok], words.start[ok] + k) + np.uint64(k))
        rows.append(own)
    return words.doc, words.hash, rows


def text_terms(part: pa.RecordBatch, column: str, decoder: Decoder):
    texts = part.column(part.schema.get_field_index(column))
    raw, offsets = text_bytes(texts)
    doc, word, rows = _terms(raw, offsets)
    extra = decoder.restored_of(texts, raw, offsets)
    if extra:
        data = [w.encode() for _, w in extra]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        _, word2, rows2 = _terms(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
        doc, word = np.concatenate([doc, [d for d, _ in extra]]).astype(np.int64), np.concatenate([word, word2])
        rows = [np.concatenate([a, b]) for a, b in zip(rows, rows2, strict=True)]
    return doc, word, rows


def _once(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    _, at = np.unique(word ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return at


def _count_features(decoder):
    """How many (document, distinct word) have each feature. The feature 0 counts all of
    them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            doc, word, rows = text_terms(part, "text", decoder.value)
            at = _once(doc, word)
            flat = np.concatenate([r[at] for r in rows])
            value, n = np.unique(flat[flat != 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[value.view(np.int64), 0]), pa.array(np.r_[n, len(at)].astype(np.int64))], names=["feature", "n"])

    return run


class Lexicon:
    """Sorted features with their log-likelihood ratios, and the logistic model."""

    def __init__(self, table: np.ndarray, weight: np.ndarray):
        self.table, self.weight = table, weight
        self.mean = self.scale = self.beta = None

    def summary(self, part: pa.RecordBatch, column: str, decoder: Decoder) -> np.ndarray:
        """A few sums for each text over the features its distinct words have."""
        doc, word, rows = text_terms(part, column, decoder)
        n = part.num_rows
        best = np.zeros(len(doc))
        for r in rows:
            at, found = find_sorted(self.table, r)
            best[at] = np.maximum(best[at], self.weight[found])
        hit = np.flatnonzero(best)
        hit = hit[_once(doc[hit], word[hit])]
        doc_hit, w = doc[hit], best[hit]
        words = np.bincount(doc, minlength=n)
        total = np.bincount(doc_hit, w, n)
        top = np.zeros(n)
        np.maximum.at(top, doc_hit, w)
        k = np.bincount(doc_hit, minlength=n)
        return np.stack([np.minimum(total, 60), top, np.log1p(k), np.log1p(100 * total / np.maximum(words, 20)), np.log1p(words)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        beta = np.zeros(z.shape[1])
        ridge = np.diag([1e-3] + [1.0] * (z.shape[1] - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(x))
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        return 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held_out: int = 2, sample: int = SAMPLE, least_ratio: float = 2.0):
    """(decoder, lexicon) as broadcasts. The trigram counts are of all documents; the
    rest is learned from at most ``sample`` labelled rows."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    decoder = sc.broadcast(Decoder(trigram_model(texts)))
    chosen = training_ids(labels, label, mod, held_out, sample)
    # one row for each id, so that repeated ids leave the bound as it is
    known = stash(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    n_toxic, n_all = known.where("label = 1").count(), known.count()
    lexicon = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if not 0 < n_toxic < n_all:
        return decoder, sc.broadcast(lexicon)

    def counted(label: int) -> DataFrame:
        rows = known.where(F.col("label") == label).select("text").mapInArrow(_count_features(decoder), "feature long, n long")
        return stash(rows.groupBy("feature").agg(F.sum("n").alias(f"n{label}")))

    one, zero = counted(1), counted(0)
    all_one, all_zero = (df.where("feature = 0").agg(F.sum(c)).first()[0] or 1 for df, c in ((one, "n1"), (zero, "n0")))
    least = max(3, n_toxic // 100)
    both = one.where(F.col("feature") != 0).where(F.col("n1") >= least).join(zero, "feature", "left")
    ratio = F.log((F.col("n1") + 0.5) / all_one) - F.log((F.coalesce("n0", F.lit(0)) + 0.5) / all_zero)
    # features of the sample alone, whose size is bounded
    kept = both.select("feature", ratio.alias("ratio")).where(F.col("ratio") >= least_ratio).toPandas()
    table = kept["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(table)
    lexicon = Lexicon(table[order], kept["ratio"].to_numpy(np.float64)[order])
    shared = sc.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            x = shared.value.summary(part, "text", decoder.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["doc_id", "label", "x"])

    rows = known.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    lexicon.fit(np.array(rows["x"].tolist()), rows["label"].to_numpy(np.float64))
    return decoder, sc.broadcast(lexicon)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held_out: int = 2, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    decoder, lexicon = fit_toxicity(docs, labels, label, mod, held_out, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lexicon.value.score(lexicon.value.summary(part, "text", decoder.value)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents that score below ``threshold``, all columns as they came."""
    decoder, lexicon = fit_toxicity(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            x = lexicon.value.summary(filled(rows, "text"), "text", decoder.value)
            yield rows.filter(pa.array(lexicon.value.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
