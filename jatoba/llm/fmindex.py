"""A compressed full-text index: Burrows-Wheeler transform in a wavelet matrix of packed bits.

All queries are vectorised over many patterns at once.  Memory is about (log2 alphabet) * 1.5 bits per
symbol for the wavelet matrix and four bytes per symbol for the document array.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:], dtype=np.int32)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        cur = symbols
        for b in range(levels - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(np.uint8)
            v = Bits(bit)
            self.bits.append(v)
            self.zeros.append(len(cur) - v.ones)
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i; ``start`` is the place of c's first symbol on the last level."""
        i = i.astype(np.int64)
        for b, v, z in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            r = v.rank(i)
            i = np.where((c >> b) & 1, z + r, i - r)
        return i - start


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and, by place, whether a suffix has other first ``depth`` symbols than its
    predecessor.  Prefix doubling; the text must end in a symbol that is nowhere else."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    have, differs = 1, None
    order = np.argsort(rank, kind="stable")
    while True:
        if have * 2 > depth and differs is None:
            # classes by the first ``depth`` symbols: those by ``have`` at 0 and at depth - have
            second = np.full(n, -1, np.int64)
            second[: n - (depth - have)] = rank[depth - have :]
            key = rank * (n + 1) + second + 1
            differs = key
        if rank.max() == n - 1:
            break
        second = np.full(n, -1, np.int64)
        second[: n - have] = rank[have:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = new
        have *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    if differs is None:  # all suffixes differ before that depth
        return order, np.ones(n, bool)
    k = differs[order]
    return order, np.concatenate([[True], k[1:] != k[:-1]])


class FMIndex:
    """Over documents of symbols >= 1; each carries a number whose least over a match is asked for."""

    def __init__(self, docs: list[np.ndarray], numbers: np.ndarray, depth: int):
        self.depth = depth
        alphabet = np.unique(np.concatenate(docs)) if docs else np.empty(0, np.int64)
        self.alphabet = alphabet
        lengths = np.array([len(d) + 1 for d in docs], np.int64)
        n = int(lengths.sum())
        text = np.zeros(n, np.int64)
        ends = np.cumsum(lengths) - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        if n:
            text[inside] = np.searchsorted(alphabet, np.concatenate(docs)) + 1
        # separators sort below all words and differ from one another, so no match crosses a document
        unique = text + len(docs)
        unique[ends] = np.arange(len(docs))[::-1]
        order, differs = suffix_array(unique, depth) if n else (np.empty(0, np.int64), np.empty(0, bool))
        bwt = text[order - 1]
        self.levels = max(1, int(len(alphabet)).bit_length())
        self.matrix = WaveletMatrix(bwt, self.levels)
        counts = np.bincount(bwt, minlength=len(alphabet) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        # place of a symbol's run on the last level of the matrix: symbols in bit-reversed order
        rev = np.zeros(len(alphabet) + 1, np.int64)
        for b in range(self.levels):
            rev |= ((np.arange(len(rev)) >> b) & 1) << (self.levels - 1 - b)
        by = np.argsort(rev)
        self.run = np.empty(len(rev), np.int64)
        self.run[by] = np.concatenate([[0], np.cumsum(counts[by])])[:-1]
        self.size = n
        begins = np.flatnonzero(differs)
        group = np.cumsum(differs) - 1
        self.low = begins[group].astype(np.int32) if n else np.empty(0, np.int32)
        self.high = np.concatenate([begins[1:], [n]])[group].astype(np.int32) if n else np.empty(0, np.int32)
        doc_of = np.repeat(np.arange(len(docs)), lengths)
        own = numbers[doc_of[order]] if n else np.empty(0, np.int64)
        # least number of each class of ``depth`` symbols: a match of that length is exactly one class
        self.least = np.minimum.reduceat(own, begins) if n else own
        self.group = group.astype(np.int32)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Words to symbols; -1 where the index has no such word."""
        i = np.searchsorted(self.alphabet, words)
        i = np.minimum(i, max(0, len(self.alphabet) - 1))
        known = self.alphabet[i] == words if len(self.alphabet) else np.zeros(len(words), bool)
        return np.where(known, i + 1, -1)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the places of c followed by what [lo, hi) matches."""
        start = self.run[c]
        return self.first[c] + self.matrix.rank(c, lo, start), self.first[c] + self.matrix.rank(c, hi, start)

    def statistics(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each position of each document: the length of the longest match that starts there, at
        most ``depth`` and never past the place where a longer one was known to end; and the least
        number of the match where it is ``depth`` long, else -1.

        Documents go through backward search side by side, from their ends.  When a word can't be put
        before the match, the match loses its last word and the word is tried again from there.
        """
        m = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        out_len = [np.zeros(k, np.int16) for k in lengths]
        out_min = [np.full(k, -1, np.int64) for k in lengths]
        if not m or not self.size:
            return out_len, out_min
        base = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.symbols(np.concatenate(docs))
        match_len, match_min = np.zeros(base[-1], np.int16), np.full(base[-1], -1, np.int64)
        pos = lengths - 1  # next word to put in front
        end = lengths.copy()  # where the current match ends
        lo, hi = np.zeros(m, np.int64), np.full(m, self.size, np.int64)
        live = np.flatnonzero(pos >= 0)
        while len(live):
            c = flat[base[live] + pos[live]]
            known = c >= 0
            a, b = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            if known.any():
                k = live[known]
                a[known], b[known] = self.extend(c[known], lo[k], hi[k])
            good = a < b
            g = live[good]
            lo[g], hi[g] = a[good], b[good]
            at = base[g] + pos[g]
            n = end[g] - pos[g]
            over = n > self.depth
            end[g[over]] -= 1
            full = n >= self.depth
            f = g[full]
            # the match of ``depth`` symbols is the whole class around the longer one
            row = lo[f]
            lo[f], hi[f] = self.low[row], self.high[row]
            match_min[at[full]] = self.least[self.group[row]]
            match_len[at] = np.maximum(match_len[at], np.minimum(n, self.depth))
            pos[g] -= 1
            bad = live[~good]
            if len(bad):
                fresh = (end[bad] - pos[bad] == 1) | (c[~good] < 0)
                # an unknown word ends every match before it; else restart one word earlier
                stop = np.where(fresh, pos[bad], end[bad] - 1)
                end[bad] = stop
                pos[bad] = stop - 1
                lo[bad], hi[bad] = 0, self.size
            live = live[pos[live] >= 0]
        return [match_len[x:y] for x, y in zip(base[:-1], base[1:], strict=True)], [match_min[x:y] for x, y in zip(base[:-1], base[1:], strict=True)]
