"""An FM-index over stretches of words, with matching statistics capped at a threshold.

The Burrows-Wheeler transform of all stretches lies in a wavelet matrix, whose planes are packed bits with the number of ones
before each 64-bit word; a backward step is one walk down the planes for many searches at once.  The suffix array is
not kept: of it remain the borders of the runs of suffixes that share their first `threshold` words, and for each
run the smallest mark of the stretches it comes from.
"""

from __future__ import annotations

import numpy as np


class Planes:
    """A wavelet matrix of symbols: bit planes, most significant first, each ordering the symbols by those before it, zeros first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.words, self.ones, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(bits):
            bit = (now >> np.uint32(bits - 1 - level) & np.uint32(1)).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            packed[: -(-len(bit) // 8)] = np.packbits(bit, bitorder="little")
            word = packed.view("<u8")
            before = np.zeros(len(word), np.int32)
            np.cumsum(np.bitwise_count(word[:-1]), out=before[1:])
            self.words.append(word)
            self.ones.append(before)
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols of the first `at` places end below the last plane, for each symbol asked for."""
        for level in range(self.bits):
            word, inside = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.ones[level][word] + np.bitwise_count(self.words[level][word] & mask)
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at


def sorted_suffixes(symbols: np.ndarray, ended: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of stretches that each end in a mark of its own (where `ended`), and which of its entries begin a run of equal first `threshold` symbols.

    Prefixes double: after k rounds suffixes are ranked by 2^k symbols; marks differ, so rounds end at the longest stretch.
    """
    n = len(symbols)
    # an ending sorts before all words, each at a rank of its own; every word after them
    rank = np.where(ended, np.cumsum(ended) - 1, symbols.astype(np.int64) + int(ended.sum()))
    _, rank = np.unique(rank, return_inverse=True)
    size, kept = 1, None
    while True:
        if size <= threshold < 2 * size:
            kept = (size, rank)
        ahead = np.full(n, -1, np.int64)
        ahead[: max(n - size, 0)] = rank[size:]
        order = np.argsort(rank * (n + 1) + ahead + 1, kind="stable")
        key = rank[order] * (n + 1) + ahead[order] + 1
        fresh = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        size *= 2
        if fresh.all() and kept is not None:
            break
    # the first `threshold` symbols are equal if those of both (overlapping) stretches of `size` symbols are
    size, known = kept
    shifted = np.full(n, -1, np.int64)
    shifted[: max(n - (threshold - size), 0)] = known[threshold - size :]
    same = (known[order][1:] == known[order][:-1]) & (shifted[order][1:] == shifted[order][:-1])
    return order, np.append(True, ~same) if n else np.zeros(0, bool)


class FmIndex:
    """An index of stretches of 64-bit words; `marks` gives each stretch a number."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, marks: np.ndarray, threshold: int):
        self.threshold = threshold
        self.alphabet, coded = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1 if len(ends) else 0
        ended = np.zeros(n, bool)
        ended[ends] = True
        symbols = np.zeros(n, np.int64)
        symbols[~ended] = coded + 1
        suffixes, fresh = sorted_suffixes(symbols, ended, threshold)
        self.n = n
        self.borders = np.flatnonzero(fresh)
        of = np.searchsorted(ends, suffixes)
        self.smallest = np.minimum.reduceat(marks[of], self.borders) if n else marks[:0]
        before = symbols[suffixes - 1] if n else symbols  # the place before the first is the last ending
        self.planes = Planes(before, max(1, int(len(self.alphabet)).bit_length()))
        self.first = np.append(0, np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))).astype(np.int64)
        symbol = np.arange(len(self.alphabet) + 1)
        self.base = self.planes.walk(symbol, np.zeros(len(symbol), np.int64)) if n else np.zeros(len(symbol), np.int64)

    def _step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = self.planes.walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        shift = self.first[symbol] - self.base[symbol]
        return ends[: len(symbol)] + shift, ends[len(symbol) :] + shift

    def statistics(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the streamed stretches, how many words from it on the index holds, as far as that is `threshold`, and the smallest mark of stretches that hold them.

        All stretches are searched at once, each from its end to its begin.  A search that has `threshold` words keeps the run of its
        interval, which forgets the last word; one that finds nothing begins anew one word further left than the match that
        failed, so places whose match is shorter than `threshold` have the length 0 and the mark -1.
        """
        first = np.cumsum(lengths) - lengths
        at = np.searchsorted(self.alphabet, words)
        symbol = np.where(at < len(self.alphabet), at, 0)
        known = (self.alphabet[symbol] == words) if len(self.alphabet) else np.zeros(len(words), bool)
        symbol = np.where(known, symbol + 1, 0)
        held, mark = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        lane = np.flatnonzero(lengths >= self.threshold) if self.n else np.zeros(0, np.int64)
        begin = first[lane]
        place = begin + lengths[lane] - 1  # the word that is to be met next
        depth = np.zeros(len(lane), np.int64)
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        while len(lane):
            word = symbol[place]
            lo, hi = self._step(word, lo, hi)
            good = (word > 0) & (lo < hi)
            depth = depth + 1
            full = good & (depth >= self.threshold)
            run = np.searchsorted(self.borders, lo[full], "right") - 1
            lo[full] = self.borders[run]
            hi[full] = np.append(self.borders[1:], self.n)[run]
            held[place[full]], mark[place[full]] = self.threshold, self.smallest[run]
            depth[full] = self.threshold
            # of a match of `depth` words that fails, the next one ends before its last word
            place = np.where(good, place - 1, place + depth - 2)
            lo, hi = np.where(good, lo, 0), np.where(good, hi, self.n)
            depth = np.where(good, depth, 0)
            left = (place >= begin) & (place - begin + 1 + depth >= self.threshold)
            lane, begin, place, depth, lo, hi = (x[left] for x in (lane, begin, place, depth, lo, hi))
        return held, mark
