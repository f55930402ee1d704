"""FM-index over a sequence of small integers: wavelet matrix of the Burrows-Wheeler transform, ranks for many queries at once.

Symbol 0 separates pieces of text; no pattern holds it. All queries are arrays: one numpy call moves every pattern a step.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Places of the suffixes of seq in order. Separators (0) rank below all else and by place, so no two suffixes are equal beyond one."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    separators = np.flatnonzero(seq == 0)
    first = seq.astype(np.int64) + len(separators)
    first[separators] = np.arange(len(separators))
    # two symbols at once to begin with
    top = int(first.max()) + 2
    pair = first * top
    pair[:-1] += first[1:] + 1
    order = np.argsort(pair, kind="stable")
    rank, unsorted = _ranks(pair[order], order, n)
    h = 2
    while len(unsorted):
        # only suffixes of equal rank are sorted again, by the rank of what follows h symbols on
        places = order[unsorted]
        after = np.where(places + h < n, rank[np.minimum(places + h, n - 1)] + 1, 0)
        own = rank[places]
        again = np.argsort(own * (n + 2) + after, kind="stable")
        places, own, after = places[again], own[again], after[again]
        order[unsorted] = places
        new = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.r_[heads, len(places)])
        rank[places] = np.repeat(unsorted[heads], sizes)
        unsorted = unsorted[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def _ranks(keys: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[heads, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    return rank, np.flatnonzero(np.repeat(sizes > 1, sizes))


class Wavelet:
    """Wavelet matrix: bit vectors in 64-bit words with a running count for each word."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(seq)
        self.words, self.counts, self.zeros = [], [], []
        seq = seq.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bit = (seq >> np.uint32(level)) & np.uint32(1)
            packed = np.zeros((self.n >> 6) + 1, np.uint64)
            raw = np.packbits(bit.astype(bool), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed))[:-1]].astype(np.uint32))
            zero = bit == 0
            self.zeros.append(int(zero.sum()))
            seq = np.concatenate([seq[zero], seq[~zero]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word].astype(np.int64) + np.bitwise_count(self.words[k][word] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the first i places, beyond where its block begins; see start()."""
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1
            ones = self._ones(k, i)
            i = np.where(one == 1, self.zeros[k] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and their places among the sorted symbols of the last level."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = ((self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(k, i)
            i = np.where(one == 1, self.zeros[k] + ones, i - ones)
            symbol = symbol * 2 + one
        return symbol, i


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16) -> None:
        """seq: symbols below sigma; it should end with a separator."""
        self.n = len(seq)
        order = suffix_array(seq)
        self.order = order
        bwt = seq[order - 1]
        self.wavelet = Wavelet(bwt, sigma)
        # where the block of a symbol begins in the last level, for every symbol
        every = np.arange(sigma, dtype=np.int64)
        self.start = self.wavelet.rank(every, np.zeros(sigma, np.int64))
        self.less = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))][:sigma].astype(np.int64)
        self.sample = sample
        marked = (order % sample == 0) | (bwt == 0)  # so that no walk crosses a separator
        self.marks = Wavelet(marked.astype(np.uint32), 2)
        self.sampled = order[marked].astype(np.int64)

    def drop_order(self) -> FMIndex:
        """Forget the whole suffix array; the sampled part is enough to locate."""
        del self.order
        return self

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with symbol and go on as those in rows lo to hi."""
        base = self.less[symbol] - self.start[symbol]
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + both[: len(lo)], base + both[len(lo) :]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo to hi of each pattern (a row of symbols, from the left); none: lo = hi."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max()) + 1 if len(lengths) else 0):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back].astype(np.int64)
            lo[live], hi[live] = self.step(symbol, lo[live], hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in seq of the suffixes in these rows: steps back to the next sampled one."""
        at, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            bit, place = self.marks.access(at[todo])
            hit = bit == 1
            out[todo[hit]] = self.sampled[place[hit] - self.marks.zeros[0]] + steps
            todo = todo[~hit]
            if len(todo):
                symbol, last = self.wavelet.access(at[todo])
                at[todo] = self.less[symbol] + last - self.start[symbol]
            steps += 1
        return out


class ListIndex:
    """The part of an FM-index that backward search needs: for each symbol, the places where the Burrows-Wheeler transform has it, in one sorted array. Eight bytes a symbol, but a step is a single search."""

    def __init__(self, seq: np.ndarray) -> None:
        """seq: as for FMIndex."""
        self.n = len(seq)
        self.order = suffix_array(seq)
        bwt = seq[self.order - 1].astype(np.int64)
        self.keys = bwt * (self.n + 1) + np.arange(self.n)
        self.keys.sort()

    def drop_order(self) -> ListIndex:
        del self.order
        return self

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As FMIndex.step: before a key come all those of lesser symbols, and the symbol's own in the rows before."""
        base = symbol.astype(np.int64) * (self.n + 1)
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)
