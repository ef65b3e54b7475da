"""Vectorised word hashing straight from Arrow text buffers.

A word is ``[^\\x20\\x09-\\x0D]+``.  Its 64-bit hash is a polynomial of its UTF-8 bytes modulo 2**64
over an odd base, finished by a mixer; prefix sums give all words of a slice at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _U(0xD6E8FEB86659FD93)
_VALUES = (np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) << _U(1)) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(m, _U(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if m > 1 << 22:  # a giant text: not kept
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


@dataclass
class Words:
    """Words of a slice of texts: hashes, byte spans in ``data``, and per text the first word's index."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffers(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return Words(data, np.empty(0, np.uint64), e, e, np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = solid[inner]  # a text's first byte begins a word even where the last text ended in one
    stops = np.zeros(n + 1, bool)
    stops[1:n] = solid[:-1] & ~solid[1:]
    stops[n] = solid[-1]
    stops[inner] = solid[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, text borders ignored (len - k + 1)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _GRAM
        acc += hashes[j : j + n]
    return mix(acc)


def within(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """For each start of a k-gram, whether all its words are of one text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    owner = owners(first)
    return owner[:n] == owner[k - 1 :]


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
