"""Token ids of whole texts from a word-level BPE file, through the tokenizers library.

The vocabulary drops white space and never joins across it, so ids of a text are
those of its words one after the other.  Each distinct word is encoded by the library
once per worker; texts that hold a special token's string go through it whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from . import bytetext as bt
from .token_counts import _LETTER, _PUNCT, REMEMBERED, rows_with


def pieces(block: bt.Block) -> bt.Spans:
    """Words, cut further between ASCII letters or digits and ASCII punctuation other than the apostrophe."""
    data, n = bt.LOWER[block.data], len(block.data)
    words = bt.words(block, lower=True)
    if n < 2 or not len(words.starts):
        return words
    change = (_LETTER[data[:-1]] & _PUNCT[data[1:]]) | (_PUNCT[data[:-1]] & _LETTER[data[1:]])
    cut = np.zeros(n, bool)
    cut[1:] = change
    cut[words.starts] = True
    starts = np.flatnonzero(cut)
    ended = np.zeros(n + 1, bool)
    ended[words.ends] = True
    ended[1:n] |= change
    # a change of kind across the border of two texts is a border anyway
    ends = np.flatnonzero(ended)
    return bt.Spans(starts, ends, bt.hash_spans(data, starts, ends), np.searchsorted(starts, block.offsets))


class SpanIds:
    """Ids of distinct spans by their hash, in one growing array; `compute` gives those of new ones."""

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.compute = compute
        self._forget()

    def _forget(self) -> None:
        self.known = bt.KeyIndex()
        self.flat, self.begins, self.n_ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 15, np.int64), 0

    def _learn(self, keys: np.ndarray, found: list[bytes]) -> np.ndarray:
        flat, lengths = self.compute(found)
        n = self.known.n
        while self.n_ids + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(lengths) + 1 > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
        self.flat[self.n_ids : self.n_ids + len(flat)] = flat
        self.begins[n + 1 : n + len(lengths) + 1] = self.n_ids + np.cumsum(lengths)
        self.n_ids += len(flat)
        return self.known.add(keys)

    def per_span(self, data: np.ndarray, spans: bt.Spans) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans one after the other, and where each span's begin (one more entry than spans)."""
        hashes, at, back = np.unique(spans.hashes, return_index=True, return_inverse=True)
        if self.known.n > REMEMBERED or self.n_ids > 8 * REMEMBERED:
            self._forget()
        slots = self.known.find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            held = data.tobytes()
            slots[new] = self._learn(hashes[new], [held[a:b] for a, b in zip(spans.starts[at[new]].tolist(), spans.ends[at[new]].tolist(), strict=True)])
        of = slots[back]
        begins = self.begins[of]
        lengths = self.begins[of + 1] - begins
        ahead = np.zeros(len(of) + 1, np.int64)
        np.cumsum(lengths, out=ahead[1:])
        return self.flat[np.arange(ahead[-1]) + np.repeat(begins - ahead[:-1], lengths)], ahead

    def ids(self, data: np.ndarray, spans: bt.Spans) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans one after the other, and where each text's begin."""
        found, ahead = self.per_span(data, spans)
        return found, ahead[spans.first]


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spans = SpanIds(self._compute)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _compute(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids([w.decode("utf-8") for w in found])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())), lengths

    def encode(self, block: bt.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's begin."""
        ids, first = self.spans.ids(bt.LOWER[block.data], pieces(block))
        odd = rows_with(block, self.special)
        if len(odd):
            parts = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for row in odd.tolist():
                parts[row] = np.array(self._ids([block.data[block.offsets[row] : block.offsets[row + 1]].tobytes().decode("utf-8")])[0], np.int32)
            ids = np.concatenate(parts)
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
