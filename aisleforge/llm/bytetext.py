"""Byte-level text kernels shared by the operators of this subpackage.

Everything here works on Arrow string columns without creating Python strings:
a column's data buffer is cut into blocks of whole texts, and words, lines and
their 64-bit hashes are found with numpy over the block's bytes.  A null text
counts as an empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point in UTF-8.
LEADING = (np.arange(256) & 0xC0) != 0x80

BLOCK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), BLOCK_BYTES)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Whole texts: rows lo..hi of the column, their bytes, and where each begins (one more entry than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have their flag set."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Spans:
    """Words or lines: byte ranges, their hashes, and the first span of each text (one more entry than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of about `limit` bytes; a longer text is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def release() -> None:
    """Gives memory that allocators keep after a task back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of 64-bit values: a polynomial over them, then a finalizer."""
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=total[1:])
    found = total[ends] - total[starts]
    found *= inverse[starts]
    return mix(found)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, each byte standing for a random value."""
    return hash_ranges(_BYTE[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges one after the other with one space between, and where each begins and ends."""
    size = ends - starts
    new_ends = np.cumsum(size + 1) - 1
    new_starts = new_ends - size
    tight = np.full(int(new_ends[-1]) + 1 if len(size) else 0, 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    tight[np.repeat(new_starts, size) + at] = data[np.repeat(starts, size) + at]
    return tight, new_starts, new_ends


def words(block: Block, lower: bool, gaps: np.ndarray = SPACE) -> Spans:
    """Maximal runs of bytes that are not gaps, by default not white space; a text's end ends a word."""
    data = LOWER[block.data] if lower else block.data
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none.astype(np.uint64), np.zeros(block.rows + 1, np.int64))
    space = gaps[data]
    fresh = np.empty(n + 1, bool)  # nothing before this byte belongs to its word
    fresh[0] = fresh[n] = True
    fresh[1:n] = space[:-1]
    fresh[block.offsets] = True
    inside = ~space
    starts = np.flatnonzero(inside & fresh[:n])
    follows = fresh[1:].copy()
    follows[:-1] |= space[1:]
    ends = np.flatnonzero(inside & follows) + 1
    return Spans(starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, block.offsets))


def lines(block: Block) -> Spans:
    """The parts of each text between line feeds, empty ones included."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([block.offsets[1:], breaks]), kind="stable")
    feeds = np.searchsorted(breaks, block.offsets)
    first = feeds + np.arange(block.rows + 1)
    return Spans(starts, ends, hash_spans(block.data, starts, ends), first)


def windows(spans: Spans, width: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of `width` consecutive spans, and where each text's windows begin.

    With whole_if_short a text of fewer spans, but at least one, has one window: all its spans.
    """
    counts = np.diff(spans.first)
    made = np.maximum(counts - width + 1, 0)
    if whole_if_short:
        made = np.where((counts > 0) & (counts < width), 1, made)
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=first[1:])
    at = np.arange(first[-1]) + np.repeat(spans.first[:-1] - first[:-1], made)
    length = np.minimum(np.repeat(counts, made), width)
    found = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = length > k
        step = spans.hashes[np.where(inside, at + k, 0)] if len(at) else found
        found = (found + np.where(inside, step, np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
    return mix(found), first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, 0 for an empty one."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class KeyTable:
    """An open-addressing table from 64-bit keys to numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)))) + 2))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys, self.values = keys.astype(np.uint64), values
        at, left = self._home(self.keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that want a slot the last one gets it
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the table's values, -1 where missing."""
        at = self._home(keys)
        found = self.slots[at]
        if not len(self.keys):
            return found
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found


class KeyIndex:
    """Numbers 64-bit keys in the order in which they are added; looked up for whole arrays, memory follows the keys."""

    def __init__(self) -> None:
        self.n = 0
        self._sized(12)

    def _sized(self, bits: int) -> None:
        held = self.keys[: self.n] if self.n else np.zeros(0, np.uint64)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots, self.keys = np.full(1 << bits, -1, np.int32), np.zeros(1 << (bits - 1), np.uint64)
        self.keys[: self.n] = held
        self._place(np.arange(self.n, dtype=np.int32))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _place(self, left: np.ndarray) -> None:
        at = self._home(self.keys[left])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that want a slot the last one gets it
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 of those not added."""
        at = self._home(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers new keys, which must differ from each other and from those held."""
        new = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        if self.n + len(keys) > len(self.keys):
            self._sized(int(np.ceil(np.log2(self.n + len(keys)))) + 2)
        self.keys[new] = keys
        self.n += len(keys)
        self._place(new)
        return new
