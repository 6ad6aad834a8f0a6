"""SentencePiece encoding and decoding of a BPE model as a max-plus parallel scan.

BPE merges are not the maximum of any sum of piece scores, but they are that of a sum over
neighbours: a pair of pieces scores 0 where merging the characters of both gives exactly the two
again, and -inf otherwise.  Of all ways to cut a text into pieces that encode to themselves one
alone scores 0 (merges inside a span happen in the same order whatever stands around it), and it is what
the library's merges give.

Long texts are cut into chunks of CHUNK bytes.  The state at a border is the piece that covers the
character before it, with what it reaches beyond.  A chunk is a max-plus matrix from the
states at its left border to those at its right one; matrices combine associatively, so prefix and suffix
scans give the state at every border, after which each chunk is traced back on its own.  Where no piece
of the vocabulary can reach across (before a space that follows another character) the state
is void: the stretches in between are units, and distinct units are traced once per worker.  A chunk
therefore needs its matrix only from the border to the first such place and from the last one to the next border.

Memory follows the block of texts (a fixed size, or one text), never the square of anything: matrices are as wide as
the pieces that can cross one border, units and chunks are traced in slices of SLICE characters.

Defined results: a null text counts as empty, which has no pieces; a character without a piece
becomes its UTF-8 bytes' pieces; repeated rows are encoded row by row; an empty table gives no rows; kept columns
named like an output give way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from ..operators.scratch import extended
from .kept import with_text
from .word_ids import SpanIds

SPACE_MARK = "▁"
CHUNK = 4096
SLICE = 1 << 16
#: Pairs of pieces whose score a worker remembers before it starts afresh; it bounds memory, not results.
PAIRS = 1 << 20
_NEVER = np.float32(-np.inf)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NO_RANK = np.int32(2**31 - 1)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices: first a, then b."""
    found = np.full((*a.shape[:-1], b.shape[-1]), _NEVER, a.dtype)
    for m in range(a.shape[-1]):
        np.maximum(found, a[..., :, m, None] + b[..., None, m, :], out=found)
    return found


def prefix_scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, in log2(n) combining steps."""
    found, step = matrices.copy(), 1
    while step < len(found):
        found[step:] = combine(found[:-step], found[step:])
        step *= 2
    return found


def suffix_scan(matrices: np.ndarray) -> np.ndarray:
    """Products of all matrices from the first, second, ... on."""
    return prefix_scan(matrices[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1)


def _values(chars: np.ndarray) -> np.ndarray:
    """Random 64-bit values of characters, from which a string's hash is a polynomial."""
    return bt.mix(chars.astype(np.uint64) + np.uint64(0x51ED))


@dataclass
class Occurrences:
    """Pieces in a stretch of characters, ordered by where they end; those that end at e are begin[e]..begin[e + 1]."""

    start: np.ndarray
    length: np.ndarray
    place: np.ndarray
    begin: np.ndarray


@dataclass
class Jobs:
    """Stretches to trace: characters one after the other, where each stretch begins, its own length, and how much of its unit is seen."""

    chars: np.ndarray
    base: np.ndarray
    own: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, int]]) -> Jobs:
        seen = np.array([len(c) for c, _ in parts], np.int64)
        base = np.cumsum(seen) - seen
        return cls(np.concatenate([c for c, _ in parts]), base, np.array([n for _, n in parts], np.int64), seen)


def _sliced(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive items of about `most` in sum."""
    total = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


class Vocabulary:
    """Pieces of a SentencePiece BPE model file, and which of them may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(held.get_piece_size())
        self.pieces = [held.id_to_piece(i) for i in ids]
        self.bytes = np.full(256, -1, np.int32)
        for i in ids:
            if held.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        plain = [i for i in ids if not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i))]
        alphabet = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1}
        if any(c not in alphabet for i in plain for c in self.pieces[i]) or (self.bytes < 0).any():
            raise ValueError("the scan needs a BPE model with byte fallback in which every character of a piece is a piece")
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.crossing = any(a != SPACE_MARK and b == SPACE_MARK for i in plain for a, b in zip(self.pieces[i], self.pieces[i][1:]))
        #: places: of a plain piece in ids; then of any character without a piece, and of a unit's beginning
        self.ids = np.array(plain, np.int32)
        self.unknown, self.begin = len(plain), len(plain) + 1
        self.lengths = np.array([*(len(self.pieces[i]) for i in plain), 1, 0], np.int64)
        self.powers = np.multiply.accumulate(np.array([1, *[_BASE] * (2 * self.longest)], np.uint64))
        self.values = np.zeros((len(plain), self.longest), np.uint64)
        codes = np.frombuffer("".join(self.pieces[i].ljust(self.longest, "\0") for i in plain).encode("utf-32-le"), np.uint32).reshape(-1, self.longest)
        inside = np.arange(self.longest) < self.lengths[:-2, None]
        self.values[inside] = _values(codes[inside])
        hashes = [np.zeros(len(plain), np.uint64)]
        for k in range(self.longest):
            hashes.append(hashes[-1] * _BASE + self.values[:, k])
        whole = np.stack(hashes)[self.lengths[:-2], np.arange(len(plain))]
        scores = np.array([held.get_score(i) for i in plain])
        self.ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.merged = bt.KeyTable(whole, self.ranks)
        # a piece that merges do not give is in no text's encoding
        alone = np.concatenate([self._merge(self.values[s], self.lengths[:-2][s], np.full(len(plain), 99)[s])[1] for s in _sliced(np.ones(len(plain)), 4096)])
        starts = np.unique(np.concatenate([hashes[k + 1][inside[:, k]] for k in range(self.longest)]))
        place = bt.KeyTable(whole[alone], np.flatnonzero(alone))
        at = place.find(starts)
        self.prefixes = bt.KeyTable(starts, np.where(at >= 0, place.values[np.maximum(at, 0)], -1))
        self.pairs, self.fits = bt.KeyIndex(), np.zeros(1 << 12, bool)
        self.spans = SpanIds(self._compute)
        #: how many texts were cut into chunks, and into how many
        self.n_chunked = self.n_chunks = 0
        decoded = [b"" if held.is_control(i) else " ⁇ ".encode() if held.is_unknown(i) else bytes([int(self.pieces[i][3:5], 16)]) if held.is_byte(i) else self.pieces[i].replace(SPACE_MARK, " ").encode() for i in ids]
        self.text_bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.text_begin = np.concatenate([[0], np.cumsum([len(d) for d in decoded])])

    def _merge(self, values: np.ndarray, n: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row's n characters: whether none of the merges crosses the border, and whether one symbol is left."""
        rows, width = values.shape
        hashes, size = values.copy(), np.ones(values.shape, np.int64)
        column = np.arange(width)
        after, before = np.where(column + 1 < n[:, None], column + 1, width), np.broadcast_to(column - 1, values.shape).copy()
        rank = np.full((rows, width), _NO_RANK)

        def ranked(r: np.ndarray, c: np.ndarray) -> None:
            d = after[r, c]
            ok = d < width
            rank[r[~ok], c[~ok]] = _NO_RANK
            r, c, d = r[ok], c[ok], d[ok]
            at = self.merged.find(hashes[r, c] * self.powers[size[r, d]] + hashes[r, d])
            rank[r, c] = np.where(at >= 0, self.merged.values[np.maximum(at, 0)], _NO_RANK)

        ranked(*np.nonzero(column < n[:, None] - 1))
        stays, live = np.ones(rows, bool), np.arange(rows)
        while len(live):
            c = rank[live].argmin(axis=1)  # the leftmost of the best
            going = rank[live, c] != _NO_RANK
            live, c = live[going], c[going]
            d = after[live, c]
            crosses = (c < border[live]) & (d >= border[live])
            stays[live[crosses]] = False
            live, c, d = live[~crosses], c[~crosses], d[~crosses]
            hashes[live, c] = hashes[live, c] * self.powers[size[live, d]] + hashes[live, d]
            size[live, c] += size[live, d]
            rank[live, d] = _NO_RANK
            e = after[live, d]
            after[live, c] = e
            follows = e < width
            before[live[follows], e[follows]] = c[follows]
            ranked(live, c)
            led = before[live, c] >= 0
            ranked(live[led], before[live[led], c[led]])
        return stays, size[:, 0] == n

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pairs of places score 0."""
        found = np.ones(len(left), bool)
        asked = np.flatnonzero((left < self.unknown) & (right < self.unknown))
        if not len(asked):
            return found
        keys = left[asked].astype(np.uint64) << np.uint64(32) | right[asked].astype(np.uint64)
        at = self.pairs.find(keys)
        if (at < 0).any():
            new = np.unique(keys[at < 0])
            if self.pairs.n + len(new) > PAIRS:
                self.pairs, new = bt.KeyIndex(), np.unique(keys)
            a, b = (new >> np.uint64(32)).astype(np.int64), (new & np.uint64(0xFFFFFFFF)).astype(np.int64)
            places = self.pairs.add(new)
            while self.pairs.n > len(self.fits):
                self.fits = np.concatenate([self.fits, np.zeros_like(self.fits)])
            for s in _sliced(np.ones(len(new)), 4096):
                la, lb = self.lengths[a[s]], self.lengths[b[s]]
                column = np.arange(int((la + lb).max()))
                in_left = column < la[:, None]
                values = np.where(in_left, self.values[a[s][:, None], np.minimum(column, self.longest - 1)], self.values[b[s][:, None], np.clip(column - la[:, None], 0, self.longest - 1)])
                self.fits[places[s]] = self._merge(values, la + lb, la)[0]
            at = self.pairs.find(keys)
        found[asked] = self.fits[at]
        return found

    def occurrences(self, jobs: Jobs) -> Occurrences:
        """Every piece that begins in a job's own stretch and ends in what it sees of its unit."""
        chars = jobs.chars
        limit = np.repeat(jobs.base + jobs.seen, jobs.seen)
        values = _values(chars)
        at = np.arange(len(chars))
        at = at[at < np.repeat(jobs.base + jobs.own, jobs.seen)]
        hashes = np.zeros(len(at), np.uint64)
        found = []
        for k in range(1, self.longest + 1):
            ok = at + k <= limit[at]
            at, hashes = at[ok], hashes[ok] * _BASE + values[at[ok] + k - 1]
            slot = self.prefixes.find(hashes)
            hit = slot >= 0
            if k == 1:
                lost = at[~hit]
                found.append((lost, np.ones(len(lost), np.int64), np.full(len(lost), self.unknown)))
            at, hashes, place = at[hit], hashes[hit], self.prefixes.values[slot[hit]]
            whole = place >= 0
            found.append((at[whole], np.full(int(whole.sum()), k), place[whole]))
            if not len(at):
                break
        start, length, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start + length, kind="stable")
        start, length, place = start[order], length[order], place[order]
        return Occurrences(start, length, place, np.searchsorted(start + length, np.arange(len(chars) + 2)))

    def reach(self, jobs: Jobs, held: Occurrences, job: np.ndarray, offset: np.ndarray, place: np.ndarray) -> np.ndarray:
        """[lane, position]: the last piece of the one path that scores 0 from a lane's entry to there, -1 if there is none.

        A lane begins in its job at `offset`, after the piece `place`.  Lanes of a job whose last pieces agree over the
        longest piece's width agree for good, so now and then only one of them goes on.
        """
        base, own = jobs.base[job], jobs.own[job]
        last = np.full((len(job), int(own.max(initial=0)) + 1), -1, np.int32)
        last[np.arange(len(job)), offset] = place
        going, merged, check = np.arange(len(job)), [], 2 * self.longest if len(job) > len(jobs.own) else last.shape[1]
        for j in range(1, last.shape[1]):
            lanes = going[(own[going] >= j) & (offset[going] < j)]
            lo = held.begin[base[lanes] + j]
            n = held.begin[base[lanes] + j + 1] - lo
            of = np.repeat(np.arange(len(lanes)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
            lane = lanes[of]
            q = last[lane, j - held.length[at]]
            ok = np.flatnonzero(q >= 0)
            lane, q, p = lane[ok], q[ok], held.place[at[ok]]
            fits = self.compatible(q, p)
            last[lane[fits], j] = p[fits]
            if j == check:
                check *= 2
                _, kept, of = np.unique(np.column_stack([job[lanes], last[lanes, j + 1 - self.longest : j + 1]]), axis=0, return_index=True, return_inverse=True)
                merged.append((j, lanes, lanes[kept][of.reshape(-1)]))
                going = lanes[np.sort(kept)]
        for j, lanes, of in reversed(merged):
            last[lanes, j + 1 :] = last[of, j + 1 :]
        return last

    def trace(self, last: np.ndarray, offset: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lane, start and place of the pieces of each lane's path from its entry to `end`, in order."""
        found, lanes, at = [(np.zeros(0, np.int64),) * 3], np.arange(len(last)), end.copy()
        while True:
            going = at > offset[lanes]
            lanes, at = lanes[going], at[going]
            if not len(lanes):
                break
            place = last[lanes, at]
            if (place < 0).any():
                raise RuntimeError("a stretch without a segmentation")
            at = at - self.lengths[place]
            found.append((lanes, at, place.astype(np.int64)))
        lane, start, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, lane))
        return lane[order], start[order], place[order]

    def _ids(self, places: np.ndarray, chars: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, given by place and first character, and how many each of n owners gets."""
        unknown = np.flatnonzero(places == self.unknown)
        ids = self.ids[np.minimum(places, self.unknown - 1)]
        if not len(unknown):
            return ids, np.bincount(owner, minlength=n)
        spelled = [self.bytes[list(chr(c).encode("utf-8"))] for c in chars[unknown].tolist()]
        times = np.ones(len(places), np.int64)
        times[unknown] = [len(s) for s in spelled]
        ids = np.repeat(ids, times)
        begins = np.cumsum(times) - times
        ids[np.concatenate([np.arange(b, b + len(s)) for b, s in zip(begins[unknown].tolist(), spelled, strict=True)])] = np.concatenate(spelled)
        return ids, np.bincount(np.repeat(owner, times), minlength=n)

    @staticmethod
    def _chars(unit: bytes) -> np.ndarray:
        return np.frombuffer(unit.decode("utf-8").replace(" ", SPACE_MARK).encode("utf-32-le"), np.uint32)

    def _compute(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole units one after the other, and how many each has."""
        units = [self._chars(u) for u in found]
        lengths = np.array([len(u) for u in units], np.int64)
        order = np.argsort(lengths, kind="stable")
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        for s in _sliced(np.maximum.accumulate(lengths[order]) + 8, SLICE):
            jobs = Jobs.of([(units[u], len(units[u])) for u in order[s].tolist()])
            zeros = np.zeros(len(jobs.own), np.int64)
            last = self.reach(jobs, self.occurrences(jobs), np.arange(len(jobs.own)), zeros, np.full(len(jobs.own), self.begin))
            lane, start, place = self.trace(last, zeros, jobs.own)
            made, sizes = self._ids(place, jobs.chars[jobs.base[lane] + start], lane, len(jobs.own))
            for u, part in zip(order[s].tolist(), np.split(made, np.cumsum(sizes)[:-1]), strict=True):
                ids[u] = part
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(i) for i in ids], np.int64)

    def _long(self, data: np.ndarray, borders: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """Ids of the units that a border between chunks cuts, by number of the unit.

        A chunk in which a unit ends has a matrix of rank one, the product of what its entry and its exit score, so
        products are needed over the chunks of one unit only.
        """
        unit_of = np.searchsorted(starts, borders, "right") - 1
        inner = starts[unit_of] != borders
        cuts: dict[int, list[int]] = {}
        for u, b in zip(unit_of[inner].tolist(), borders[inner].tolist(), strict=True):
            cuts.setdefault(u, []).append(b)
        if not cuts:
            return {}
        reach = self.longest - 1
        chars, marks = {}, {}
        for u, at in cuts.items():
            begin = int(starts[u])
            chars[u] = self._chars(data[begin : int(ends[u])].tobytes())
            bounds = [begin, *at]
            inside = np.cumsum([int(bt.LEADING[data[a:b]].sum()) for a, b in zip(bounds, bounds[1:])]).tolist()
            marks[u] = [0, *inside, len(chars[u])]
        # the states at each border: pieces that cover the character before it, as (characters before, beyond, place)
        windows, places = [], []
        for u in cuts:
            for m, b in enumerate(marks[u][1:-1]):
                lo = max(0, b - reach - 1)
                windows.append((chars[u][lo : b + reach], b - lo))
                places.append((u, m))
        states: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for s in _sliced(np.array([len(w) for w, _ in windows]), SLICE):
            jobs = Jobs.of(windows[s])
            held = self.occurrences(jobs)
            job = np.searchsorted(jobs.base, held.start, "right") - 1
            border = (jobs.base + jobs.own)[job]
            covers = np.flatnonzero(held.start + held.length >= border)
            order = covers[np.argsort(job[covers], kind="stable")]
            split = np.searchsorted(job[order], np.arange(1, len(jobs.own)))
            for key, rows in zip(places[s], np.split(order, split), strict=True):
                states[key] = (border[rows] - held.start[rows], held.start[rows] + held.length[rows] - border[rows], held.place[rows])
        fragments = [(u, m) for u in cuts for m in range(len(marks[u]) - 1)]
        begun = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, self.begin))

        def stretch(u: int, m: int) -> tuple[np.ndarray, int]:
            lo, hi = marks[u][m], marks[u][m + 1]
            return chars[u][lo : hi + reach], hi - lo

        def through(part: list[tuple[int, int]], entries: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
            """Each slice's jobs, and per lane: number of the fragment in it, entry offset, last pieces."""
            widths = np.array([(marks[u][m + 1] - marks[u][m] + reach) * len(e[0]) for (u, m), e in zip(part, entries, strict=True)])
            for s in _sliced(widths, 4 * SLICE):
                jobs = Jobs.of([stretch(*f) for f in part[s]])
                job = np.repeat(np.arange(len(jobs.own)), [len(e[0]) for e in entries[s]])
                offset, place = (np.concatenate([e[k] for e in entries[s]]) for k in (1, 2))
                yield s, jobs, job, offset, self.reach(jobs, self.occurrences(jobs), job, offset, place)

        def matrices(part: list[tuple[int, int]], entries: list[tuple[np.ndarray, ...]]) -> dict[tuple[int, int], np.ndarray]:
            """Scores [entry, exit] of each fragment; a unit's end is the one exit of its last fragment."""
            made = {}
            for s, jobs, job, _, last in through(part, entries):
                for k, (u, m) in enumerate(part[s]):
                    lanes = np.flatnonzero(job == k) if len(jobs.own) < 32 else np.arange(*np.searchsorted(job, [k, k + 1]))
                    n = int(jobs.own[k])
                    if (u, m) not in states:
                        made[u, m] = np.where(last[lanes, n] >= 0, np.float32(0), _NEVER)[:, None]
                        continue
                    back, _, place = states[u, m]
                    before = last[lanes[:, None], n - back[None, :]]
                    there = before >= 0
                    there[there] = self.compatible(before[there], np.broadcast_to(place, before.shape)[there])
                    made[u, m] = np.where(there, np.float32(0), _NEVER)
            return made

        first = [(u, 0) for u in cuts]
        scores = matrices(first, [begun] * len(first))
        # of a unit's first border only the states that its beginning can reach are of use
        for f in first:
            kept = scores[f][0] == 0
            scores[f] = scores[f][:, kept]
            states[f] = tuple(x[kept] for x in states[f])
        later = [f for f in fragments if f[1]]
        scores |= matrices(later, [states[u, m - 1] for u, m in later])

        chosen = {}
        for u in cuts:
            if len(cuts[u]) == 1:
                chosen[u] = [int(np.argmax(scores[u, 1][:, 0]))]
                continue
            # exits that no entry reaches are of no use either
            run = [scores[u, m] for m in range(len(marks[u]) - 1)]
            useful = [np.flatnonzero((run[m] == 0).any(axis=0)) for m in range(len(run) - 1)]
            wide = max(len(x) for x in useful)
            chunk = np.full((len(run), wide, wide), _NEVER)
            for m, x in enumerate(run):
                x = x[useful[m - 1]] if m else x
                x = x[:, useful[m]] if m < len(useful) else x
                chunk[m, : x.shape[0], : x.shape[1]] = x
            ahead, behind = prefix_scan(chunk)[:, 0, :], suffix_scan(chunk)[:, :, 0]
            best = np.argmax(ahead[:-1] + behind[1:], axis=1)
            chosen[u] = [int(x[k]) for x, k in zip(useful, best.tolist(), strict=True)]

        # every chunk on its own: from the entry to the piece that reaches over its right border
        def state(u: int, m: int) -> tuple[np.ndarray, ...]:
            k = chosen[u][m]
            return tuple(x[k : k + 1] for x in states[u, m])

        entries = [state(u, m - 1) if m else begun for u, m in fragments]
        exits = [state(u, m) if (u, m) in states else None for u, m in fragments]
        made: dict[int, list[np.ndarray]] = {u: [] for u in cuts}
        for s, jobs, _, offset, last in through(fragments, entries):
            over = exits[s]
            end = jobs.own - np.array([0 if x is None else int(x[0][0]) for x in over])
            lane, start, place = self.trace(last, offset, end)
            more = np.array([k for k, x in enumerate(over) if x is not None], np.int64)
            lane, start = np.concatenate([lane, more]), np.concatenate([start, end[more]])
            place = np.concatenate([place, *(x[2] for x in over if x is not None)])
            order = np.lexsort((start, lane))
            lane, start, place = lane[order], start[order], place[order]
            ids, sizes = self._ids(place, jobs.chars[jobs.base[lane] + start], lane, len(jobs.own))
            for (u, _), part in zip(fragments[s], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                made[u].append(part)
        return {u: np.concatenate(parts) for u, parts in made.items()}

    def encode(self, block: bt.Block, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's begin."""
        chunk = max(chunk or CHUNK, 8 * self.longest)  # no piece reaches over two borders
        filled = np.diff(block.offsets) > 0
        data = np.insert(block.data, block.offsets[:-1][filled], 0x20)
        offsets = block.offsets + np.concatenate([[0], np.cumsum(filled)])
        cut = np.zeros(len(data) + 1, bool)
        if not self.crossing and len(data):
            # raw marks are spaces to the vocabulary, so no cut after one
            cut[1 : len(data)] = (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)
        cut[offsets] = True
        starts = np.flatnonzero(cut[: len(data)])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        first = np.searchsorted(starts, offsets)

        long = np.flatnonzero(np.diff(offsets) > chunk)
        n_borders = (np.diff(offsets)[long] - 1) // chunk
        borders = np.repeat(offsets[long] - (np.cumsum(n_borders) - n_borders) * chunk, n_borders) + np.arange(1, n_borders.sum() + 1) * chunk
        while len(inside := np.flatnonzero(~bt.LEADING[data[np.minimum(borders, len(data) - 1)]] & (borders < len(data)))):
            borders[inside] += 1
        borders = np.setdiff1d(borders, offsets)
        self.n_chunked, self.n_chunks = self.n_chunked + len(long), self.n_chunks + len(borders) + len(long)
        cut_units = self._long(data, borders, starts, ends) if len(borders) else {}
        plain = np.ones(len(starts), bool)
        plain[list(cut_units)] = False
        spans = bt.Spans(starts[plain], ends[plain], bt.hash_spans(data, starts, ends)[plain], first)
        found, ahead = self.spans.per_span(data, spans)
        if not cut_units:
            return found, ahead[first]
        sizes = np.zeros(len(starts), np.int64)
        sizes[plain] = np.diff(ahead)
        ahead_of = np.cumsum(plain) - plain  # plain units before each unit
        parts, at = [], 0
        for u in sorted(cut_units):
            to = int(ahead[ahead_of[u]])
            parts += [found[at:to], cut_units[u]]
            sizes[u] = len(cut_units[u])
            at = to
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate([*parts, found[at:]]), total[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of ids one after the other, and where each text's begin, without the space that encoding puts in front."""
        sizes = np.diff(self.text_begin)[ids]
        begins = np.cumsum(sizes) - sizes
        data = self.text_bytes[np.arange(int(sizes.sum())) + np.repeat(self.text_begin[ids] - begins, sizes)]
        at = np.append(begins, len(data))[first]
        led = at[:-1][np.diff(at) > 0]
        led = led[data[led] == 0x20]
        return np.delete(data, led), at - np.searchsorted(led, at)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `pieces`, the ids of each whole text."""
    source, keep, name = with_text(docs, text_col, keep, ["pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column(name)):
                ids, first = vocabulary(path).encode(block)
                kept = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], [*keep, "pieces"])
        bt.release()

    return source.mapInArrow(run, extended(source, keep, "pieces array<int>"))


def decode_column(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, `text`, n_pieces and pieces_crc32 (of the ids as little-endian 32-bit integers)."""
    keep = [c for c in keep if c.lower() not in ("text", "n_pieces", "pieces_crc32", "pieces")]
    source = encoded.select(*keep, "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("pieces").cast(pa.large_list(pa.int32()))
                sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
                ids, first = np.asarray(lists.flatten(), np.int32), np.concatenate([[0], np.cumsum(sizes)])
                data, at = vocabulary(path).decode(ids, first)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                try:
                    texts = texts.cast(pa.large_string())
                except pa.ArrowInvalid:  # bytes that are no UTF-8 in some text
                    texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())
                held = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts.cast(pa.string()), pa.array(sizes), pa.array(np.array(crc, np.int64))], [*keep, "text", "n_pieces", "pieces_crc32"])
        bt.release()

    return source.mapInArrow(run, extended(source, keep, "text string, n_pieces long, pieces_crc32 long"))
