"""Words of many texts as 64-bit hashes, on whole Arrow batches at once.

A word's hash is a polynomial over per-byte random values modulo 2**64, so hashes of
all words (and of their prefixes) come from one cumulative sum over the bytes of a
batch. All separators are ASCII, so UTF-8 bytes can be cut without decoding.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the input reach all bits of the output."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_STEP)) | _U(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(drop: list[tuple[int, int]]) -> np.ndarray:
    keep = np.ones(256, dtype=bool)
    for a, b in drop:
        keep[a : b + 1] = False
    return keep


#: Bytes of a word: everything but white space; and letters, digits and all non-ASCII.
NOT_SPACE = _class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=_U)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * _U(step)
        have += take
        step = step * step % (1 << 64)
    return out


class Words(NamedTuple):
    hash: np.ndarray
    doc: np.ndarray  #: row of the word's text
    start: np.ndarray  #: byte positions in the batch
    end: np.ndarray
    first: np.ndarray  #: n_docs + 1 offsets into the words
    sums: np.ndarray  #: cumulative polynomial, one longer than the bytes


def split_words(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray = ALNUM) -> Words:
    n = len(raw)
    low = LOWER[raw]
    word = keep[low]
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = word
    cut = offsets[:-1]
    before[cut[cut < n + 1]] = False
    start = np.flatnonzero(word & ~before[:n])
    after = np.empty(n, dtype=bool)
    if n:
        after[:-1] = word[1:]
        after[-1] = False
        ends = offsets[1:]
        after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    size = 1 << max(10, int(n).bit_length())
    values = _BYTE[low]
    values *= _powers(size, _BASE)[:n]
    sums = np.empty(n + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    hashed = span_hash(sums, start, end)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(hashed, doc, start, end, first, sums)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, wherever they stand."""
    size = 1 << max(10, int(len(sums) - 1).bit_length())
    shifted = (sums[end] - sums[start]) * _powers(size, _INVERSE)[start]
    return mix(shifted + (end - start).astype(_U) * _U(_STEP))


def hash_words(words: list[str], keep: np.ndarray = ALNUM) -> np.ndarray:
    """The same hashes for single words given as strings."""
    data = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    found = split_words(raw, offsets, keep)
    if len(found.hash) != len(words):
        raise ValueError("each entry must be one word")
    return found.hash


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words; the caller drops those that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, dtype=_U)
    factors = mix(np.arange(1, n + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
    out = np.zeros(len(hashes) - n + 1, dtype=_U)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * factors[i]
    return mix(out + _U(n))


def find_sorted(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values that stand in the sorted table: their indexes, and where they are in it."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a small bitmap over the top bits drops most values before the binary search
    bits = 20
    mask = np.zeros(1 << bits, dtype=bool)
    mask[(table >> _U(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(mask[(values >> _U(64 - bits)).astype(np.int64)])
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    ok = table[at] == values[maybe]
    return maybe[ok], at[ok]
