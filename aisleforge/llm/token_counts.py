"""Token counts of byte-level BPE by rank-synchronous array merging.

A batch of pre-tokens lies in one ragged numpy array.  Each round looks up the rank
of every adjacent pair, takes the lowest rank of each sequence, replaces all its
occurrences there at once, and drops sequences in which nothing merges any more;
what is left is counted.  One round serves all sequences, so Python's cost is that
of the deepest sequence, not of their number.

Texts are cut into chunks at places where the vocabulary's split pattern always
cuts, whatever stands around; distinct chunks are pre-tokenized and merged once per
worker and then found by their 64-bit hash.

Defined results: a null text counts as empty (no tokens); a special token's string
inside a text is that one token, as in the library's default; repeated rows are
counted row by row; kept columns named like an output give way to it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bytetext as bt
from ..operators.scratch import extended
from .kept import with_text

#: Distinct chunks a worker remembers before it starts afresh; it bounds memory, not results.
REMEMBERED = 1 << 21
_NONE = np.int32(2**31 - 1)

_LETTER, _PUNCT, _ODD_LEAD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT[33:127] = True
_PUNCT &= ~_LETTER
_PUNCT[0x27] = False  # the apostrophe may begin a contraction
_ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # may begin a white-space character
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_BREAK = bt.SPACE.copy()
_BREAK[0x20] = False


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RankMerger:
    """Merges of a byte-level BPE vocabulary as arrays: pair keys in order, with each pair's rank and product."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocab = held["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        self.special = [t["content"] for t in held["added_tokens"]]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.pattern = regex.compile(pattern)
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        keys = left << 17 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(pairs), dtype=np.int32)[order], made.astype(np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 17 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Surviving symbols of each sequence of bytes."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        left_over = np.where(lengths == 0, 0, 1)
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        while len(symbols):
            ranks = np.full(len(symbols), _NONE, np.int32)  # of the pair that begins here
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            ranks[inner] = self.rank_of(symbols[inner], symbols[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(symbols)))
            lowest = np.minimum.reduceat(ranks, first)
            done = lowest == _NONE
            left_over[owner[first[done]]] = sizes[done]
            hits = np.flatnonzero((ranks == np.repeat(lowest, sizes)) & (ranks != _NONE))
            # equal pairs overlap only in runs of one symbol: there every other pair merges, from the left
            begins = np.concatenate([[True], np.diff(hits) != 1]) if len(hits) else np.zeros(0, bool)
            run = hits[begins][np.cumsum(begins) - 1] if len(hits) else hits
            hits = hits[(hits - run) % 2 == 0]
            symbols[hits] = self.made[ranks[hits]]
            stays = ~np.repeat(done, sizes)
            stays[hits + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return left_over

    def count_chunks(self, chunks: list[bytes]) -> np.ndarray:
        parts = [self.pattern.findall(c.decode("utf-8")) for c in chunks]
        counts = self.count([p.encode("utf-8") for ps in parts for p in ps])
        return bt.sums(counts, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


def chunks(block: bt.Block) -> bt.Spans:
    """Cuts texts where the split pattern of byte-level BPE cuts whatever stands around.

    These places are: before a space that a visible character follows; between an ASCII letter or digit and ASCII
    punctuation other than the apostrophe; on both sides of a single white-space byte other than the space.
    """
    data, n = block.data, len(block.data)
    cut = np.zeros(n + 1, bool)
    if n:
        following, before = data[1:], data[:-1]
        cut[: n - 1] |= (data[:-1] == 0x20) & (following > 0x20) & (following != 0x7F) & ~_ODD_LEAD[following]
        cut[1:n] |= (_LETTER[before] & _PUNCT[following]) | (_PUNCT[before] & _LETTER[following]) | (_PLAIN[before] & _BREAK[following])
        cut[2:n] |= _PLAIN[data[2:]] & _BREAK[data[1:-1]] & _PLAIN[data[:-2]]
        # the last byte of a text has no follower in it
        ends = block.offsets[1:][np.diff(block.offsets) > 0]
        cut[ends - 1] &= ~(data[ends - 1] == 0x20)
        cut[block.offsets] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n) if len(starts) else starts
    return bt.Spans(starts, ends, bt.hash_spans(data, starts, ends), np.searchsorted(starts, block.offsets))


def rows_with(block: bt.Block, needles: list[str]) -> np.ndarray:
    """Rows whose text holds one of the strings."""
    held = block.data.tobytes()
    found = set()
    for needle in needles:
        at = held.find(needle.encode())
        while at >= 0:
            row = int(np.searchsorted(block.offsets, at, "right")) - 1
            if at + len(needle.encode()) <= block.offsets[row + 1]:
                found.add(row)
            at = held.find(needle.encode(), at + 1)
    return np.array(sorted(found), np.int64)


class SpanCounter:
    """Sums a value of each span over the texts; values of distinct spans are kept by hash."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray]):
        self.compute, self.known, self.held = compute, bt.KeyIndex(), np.zeros(1 << 12, np.int32)

    def values(self, block: bt.Block, spans: bt.Spans) -> np.ndarray:
        hashes, at, back = np.unique(spans.hashes, return_index=True, return_inverse=True)
        if self.known.n > REMEMBERED:
            self.__init__(self.compute)
        slots = self.known.find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            data = block.data.tobytes()
            found = self.compute([data[a:b] for a, b in zip(spans.starts[at[new]].tolist(), spans.ends[at[new]].tolist(), strict=True)])
            slots[new] = self.known.add(hashes[new])
            while self.known.n > len(self.held):
                self.held = np.concatenate([self.held, np.zeros_like(self.held)])
            self.held[slots[new]] = found
        return self.held[slots[back]].astype(np.int64)


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> tuple[RankMerger, SpanCounter]:
    merger = RankMerger(path, pattern)
    return merger, SpanCounter(merger.count_chunks)


def count_block(block: bt.Block, path: str, pattern: str) -> np.ndarray:
    """Tokens of each text of a block."""
    merger, counter = _counter(path, pattern)
    spans = chunks(block)
    counts = bt.sums(counter.values(block, spans), spans.first)
    for row in rows_with(block, merger.special):
        text = block.data[block.offsets[row] : block.offsets[row + 1]].tobytes().decode("utf-8")
        parts = regex.split("|".join(regex.escape(t) for t in sorted(merger.special, key=len, reverse=True)), text)
        counts[row] = int(merger.count_chunks([p.encode("utf-8") for p in parts]).sum()) + len(parts) - 1
    return counts


def token_counts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes (UTF-8) and n_tokens of each whole text. path: of the vocabulary, on every executor."""
    source, keep, name = with_text(docs, text_col, keep, ["n_bytes", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column(name)):
                kept = batch.slice(block.lo, block.rows)
                counts = count_block(block, path, pattern)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), pa.array(np.diff(block.offsets)), pa.array(counts.astype(np.int64))], [*keep, "n_bytes", "n_tokens"])

    return source.mapInArrow(run, extended(source, keep, "n_bytes long, n_tokens long"))
