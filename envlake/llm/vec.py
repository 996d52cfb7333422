"""Vectorised words, hashes and shingles over many texts at once (numpy, inside tasks).

A word is ``[^\\x20\\x09-\\x0D]+``. Every step works on the UTF-8 bytes of a slice of rows, so
its cost is a few array passes, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply, twice)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants, the same in every process."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTE = salts(256, 11)
_LOWER = _BYTE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _LOWER[ord("a"):ord("z") + 1]
_PLACE = salts(64, 23)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of each (one more than texts)."""
    offs = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offs


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    word = ~SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    cut = offs[:-1][offs[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` folds A-Z onto a-z."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        power, inverse = _power_tables(len(data))
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * power, out=total[1:])
        return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and for each text the index of its first one.

    A text with fewer words has one shingle, the whole sequence; a text without words none.
    """
    n_docs = len(first) - 1
    counts = np.diff(first)
    n_sh = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.zeros(n_docs + 1, dtype=np.int64)
    np.cumsum(n_sh, out=at[1:])
    with np.errstate(over="ignore"):
        total = np.zeros(at[-1], dtype=U64)
        doc = np.repeat(np.arange(n_docs), n_sh)
        place = np.arange(at[-1]) - at[doc] + first[doc]
        length = np.minimum(counts, k)[doc]
        for j in range(k):
            has = j < length
            total[has] += words[place[has] + j] * _PLACE[j]
        return mix64(total + length.astype(U64) * _PLACE[-1]), at


def shingles_of(texts: list[bytes], k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingles` straight from the texts."""
    data, offs = join_texts(texts)
    starts, ends, first = word_spans(data, offs)
    return shingles(word_hashes(data, starts, ends, lower), first, k)
