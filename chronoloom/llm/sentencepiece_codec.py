"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the model can cross: before white space marks, around
line feeds, and between any two characters that stand side by side in no piece, so that
long unbroken runs are short segments too. Distinct segments of a batch lie as flat numpy symbol arrays; in
each round every segment finds its best pair (segmented minimum of pair ranks), merges
its leftmost occurrences at once, and the arrays are compacted, until no pair is left.
Where a merge makes a pair that ranks before or level with the merged one, or pairs
tie, a segment merges only its leftmost pair in that round, which keeps the result that
of one merge at a time. Characters outside the model become byte pieces.

Segments already encoded are kept in a bounded per-worker table, so each task's memory
has a bound and frequent words are encoded once.

Defined results: null or empty texts have no ids and decode to an empty text; very long
texts are cut like others; texts of white space alone have their marks as pieces.
Repeated rows give repeated results, empty tables none; further columns are ignored by
``encode_documents``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries that a task keeps, twice: about 100 MB in all.
KEPT = 120_000
#: Rounds after which the segments that are left are merged by a heap.
ROUNDS = 100


class PieceModel:
    """Pieces, ranks and pair table of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        normal = [not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)) for i in range(n)]
        score = np.array([library.get_score(i) for i in range(n)])
        _, rank = np.unique(-score, return_inverse=True)  # 0 is the best; equal scores tie
        self.id_of = {p: i for i, p in enumerate(self.pieces) if normal[i]}
        self.byte_id = [0] * 256
        for i, p in enumerate(self.pieces):
            if library.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        as_text = lambda i, p: b"" if library.is_control(i) else " ⁇ ".encode() if library.is_unknown(i) else p.replace(SPACE, " ").encode()
        self.data = [of_byte.get(i) or as_text(i, p) for i, p in enumerate(self.pieces)]
        self.names = [str(i) for i in range(n)]
        pairs = []
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(((a << 20) | b, rank[i], i))
        pairs.sort()
        self.pair = np.array([x[0] for x in pairs], dtype=np.int64)
        self.pair_rank = np.array([x[1] for x in pairs], dtype=np.int64)
        self.pair_id = np.array([x[2] for x in pairs], dtype=np.int64)
        self.none = np.int64(rank.max() + 1)
        #: two characters that stand side by side in some piece
        self.inner = np.array(sorted({ord(a) << 32 | ord(b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}), dtype=np.int64)
        if any(SPACE in p[1:].lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces that go on after a white space mark are not supported")
        whole = any("\n" in p and len(p) > 1 for p in self.id_of)
        self.segment = re.compile("▁*[^▁]+|▁+" if whole else "▁*[^▁\n]+|\n|▁+")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``none`` where there is no piece) and the piece's id.
        Symbols that are no piece are below 0."""
        key = (left << 20) | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        ok = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_rank[at], self.none), self.pair_id[at]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment; white space is written as the mark already."""
        flat = "".join(segments)
        lengths = np.array([len(x) for x in segments], dtype=np.int64)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        # a symbol that is no piece is -1 - its code point
        first = np.array([self.id_of.get(chr(c), -1 - int(c)) for c in distinct], dtype=np.int64)
        symbol = first[back] if len(points) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(segments)), lengths)
        word = np.zeros(len(points), dtype=np.int64)
        if len(points) > 1:
            key = points[:-1].astype(np.int64) << 32 | points[1:]
            at = np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)
            word[1:] = np.cumsum((self.inner[at] != key) | (owner[1:] != owner[:-1]))
        segment_of = owner[np.flatnonzero(np.r_[True, word[1:] != word[:-1]])] if len(points) else owner
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._pair_ranks(symbol, word)
        rounds = 0
        while len(symbol):
            rounds += 1
            if rounds > ROUNDS:
                cuts = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(symbol)]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = np.array(self._by_heap(symbol[a:b].tolist()), dtype=np.int64)
                    done.append((np.full(len(own), word[a]), own))
                break
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(symbol)])
            live = best < self.none
            if not live.all():
                over = np.repeat(~live, size)
                done.append((word[over], symbol[over]))
                keep = ~over
                symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
                if not len(symbol):
                    break
                size = size[live]
                starts = np.cumsum(size) - size
                best = best[live]
            best_here = np.repeat(best, size)
            hit = self._leftmost(rank == best_here)
            symbol, word, rank, made = self._merge(symbol, word, rank, made, hit, starts, best_here)
        if not done:
            return [[] for _ in segments]
        words, ids = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
        order = np.argsort(words, kind="stable")
        words, ids = segment_of[words[order]], ids[order]
        bounds = np.searchsorted(words, np.arange(len(segments) + 1))
        out = []
        lists = ids.tolist()
        odd = np.zeros(len(segments), dtype=bool)
        odd[words[ids < 0]] = True
        for i in range(len(segments)):
            own = lists[bounds[i] : bounds[i + 1]]
            if odd[i]:
                own = [y for x in own for y in ((x,) if x >= 0 else [self.byte_id[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")])]
            out.append(own)
        return out

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """The merges of one word's symbols, one at a time: the best pair first, of equal
        ones the leftmost."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0:
                key = symbols[i] << 20 | symbols[j]
                if key in self.pair_of:
                    rank, made = self.pair_of[key]
                    heapq.heappush(heap, (rank, i, key, made))

        gone = [False] * n
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, key, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] < 0 or symbols[j] < 0 or symbols[i] << 20 | symbols[j] != key:
                continue
            symbols[i], gone[j], after[i] = made, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, out in zip(symbols, gone, strict=True) if not out]

    @cached_property
    def pair_of(self) -> dict[int, tuple[int, int]]:
        """The pair table for single lookups."""
        return dict(zip(self.pair.tolist(), zip(self.pair_rank.tolist(), self.pair_id.tolist(), strict=True), strict=True))

    def _pair_ranks(self, symbol: np.ndarray, word: np.ndarray):
        rank = np.full(len(symbol), self.none, dtype=np.int64)
        made = np.zeros(len(symbol), dtype=np.int64)
        if len(symbol) > 1:
            at = np.flatnonzero(word[1:] == word[:-1])
            rank[at], made[at] = self.ranks(symbol[at], symbol[at + 1])
        return rank, made

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of runs of overlapping pairs, the first, third, ... A run never crosses words,
        as the last symbol of a word has no pair."""
        run = np.flatnonzero(np.r_[hit[:1], hit[1:] & ~hit[:-1]])
        at = np.flatnonzero(hit)
        since = at - run[np.searchsorted(run, at, side="right") - 1]
        out = np.zeros_like(hit)
        out[at[since % 2 == 0]] = True
        return out

    def _merge(self, symbol, word, rank, made, hit, starts, best_here):
        state, early = self._apply(symbol, word, rank, made, hit, best_here)
        several = np.add.reduceat(hit, starts) > 1
        if not several.any():
            return state
        # different pairs may share a rank only where scores tie
        redo = np.maximum.reduceat(np.where(hit, made, -1), starts) != np.minimum.reduceat(np.where(hit, made, 1 << 40), starts)
        if len(early):
            redo[np.searchsorted(starts, early, side="right") - 1] = True
        redo &= several
        if not redo.any():
            return state
        one = np.flatnonzero(hit)
        own = np.searchsorted(starts, one, side="right") - 1
        firsts = np.r_[True, own[1:] != own[:-1]]
        hit = hit.copy()
        hit[one[redo[own] & ~firsts]] = False
        return self._apply(symbol, word, rank, made, hit, best_here)[0]

    def _apply(self, symbol, word, rank, made, hit, best_here):
        """The arrays after the merges; only pairs beside merged symbols get new ranks.
        Also the old places of pairs that now rank level with the merged pair or before."""
        kept = np.ones(len(symbol), dtype=bool)
        kept[1:] = ~hit[:-1]
        kept = np.flatnonzero(kept)
        fresh = hit[kept]
        new_symbol, new_word, new_rank, new_made = np.where(fresh, made[kept], symbol[kept]), word[kept], rank[kept], made[kept]
        beside = fresh.copy()
        beside[:-1] |= fresh[1:]
        at = np.flatnonzero(beside)
        new_rank[at] = self.none
        inside = at[at + 1 < len(new_word)]
        inside = inside[new_word[inside] == new_word[inside + 1]]
        new_rank[inside], new_made[inside] = self.ranks(new_symbol[inside], new_symbol[inside + 1])
        early = kept[inside[new_rank[inside] <= best_here[kept[inside]]]]
        return (new_symbol, new_word, new_rank, new_made), early

    def decode_pieces(self, ids: list[int]) -> bytes:
        """UTF-8 of the ids, marks as spaces. Byte pieces stand for themselves."""
        return b"".join([self.data[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of any list of ids; the white space before the first word goes, and each
        byte that is no part of a character becomes a replacement character."""
        data = self.decode_pieces(ids)
        return one_by_one(data[1:] if data[:1] == b" " and ids and self.pieces[ids[0]].startswith(SPACE) else data)


def one_by_one(data: bytes) -> str:
    """UTF-8 with a replacement character for each byte that is no part of a character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


class Codec:
    """A worker's model with the segments it has met lately."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.seen: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def learn(self, segments: set[str]) -> None:
        if len(self.seen) > KEPT:  # what has not been met since the last time goes
            self.older, self.seen = self.seen, {}
        new = []
        for x in segments:
            if x not in self.seen:
                if x in self.older:
                    self.seen[x] = self.older[x]
                else:
                    new.append(x)
        names = self.model.names
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for text, ids in zip(part, self.model.encode_segments(part), strict=True):
                self.seen[text] = (len(ids), ",".join([names[y] for y in ids]), self.model.decode_pieces(ids))

    def forget(self) -> None:
        """Free the known segments: workers live on after a task, beside other operators."""
        self.seen, self.older = {}, {}

    def cut(self, text: str) -> list[str]:
        return self.model.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def ids(self, text: str) -> list[int]:
        parts = self.cut(text)
        self.learn(set(parts))
        return [int(x) for p in parts for x in self.seen[p][1].split(",")]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches, "text"):
            texts = [own.cut(t) for t in part.column(1).to_pylist()]
            own.learn(set().union(*texts))
            seen = own.seen
            n, ids, decoded = [], [], []
            for parts in texts:
                got = [seen[p] for p in parts]
                n.append(sum([x[0] for x in got]))
                ids.append(hashlib.sha256(",".join([x[1] for x in got]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([x[2] for x in got])[1:]).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return run


def encode_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """Digests of each document's ids and of their decoding. ``model_path`` is read by
    each worker where the library's vocabularies are installed."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    return texts.mapInArrow(_encode(model_path), SCHEMA)


def token_ids(docs: DataFrame, model_path: str, doc_text: str = "text", name: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` and the ids as the column ``name``."""
    from pyspark.sql import types as T

    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(doc_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for part in chunks(batches, doc_text):
            ids = [own.ids(t) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, name])
        own.forget()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))
