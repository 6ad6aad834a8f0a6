"""Best-fit packing by large-item matching.

Texts become pieces of at most `capacity` tokens.  Pieces over a third of a bin meet at
most twice in one bin, so they are matched greedily: the largest with the largest
partner that still fits.  Smaller pieces, largest first, go to the tightest remaining
gap, and open a bin only when no gap holds them.

Pieces of one length are interchangeable, so the plan is made on the histogram of
lengths (at most `capacity` numbers, whatever the corpus holds) and says where ranks
r..r+n of a length go.  Ranks come from each task's own count per length plus the
counts of the tasks before it, so no task sees all pieces.

Defined results: a null text counts as empty; an empty text is one piece holding the
end id; repeated rows are packed row by row; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from ..operators.scratch import stored
from .word_ids import encoder


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; and task, rank: how many pieces of this length the task made before."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for block in bt.blocks(batch.column("__text")):
                ids, first = encoder(path).encode(block)
                ids = np.insert(ids.astype("<u4"), first[1:], end_id)
                first = first + np.arange(len(first))
                n = -(-np.diff(first) // capacity)
                row = np.repeat(np.arange(block.rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(first[row + 1] - first[row] - start, capacity)
                at = first[row] + start
                held = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sized = length[order]
                begins = np.concatenate([[0], np.flatnonzero(np.diff(sized)) + 1])
                within = np.arange(len(sized)) - np.repeat(begins, np.diff(np.append(begins, len(sized))))
                rank = np.empty_like(within)
                rank[order] = within + seen[sized]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [ids_of.slice(block.lo, block.rows).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64)), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


class Plan:
    """Runs of a length's ranks: rank0.. go to bins from bin0 on, `each` per bin, the first of a bin at offset0."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.next_rank = dict.fromkeys(counts, 0)
        #: gap: intervals (first bin, how many) whose bins are filled but for it; gaps in order
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []
        left = {s: n for s, n in counts.items() if n}
        self._match(left)
        for size in sorted(left, reverse=True):
            self._fit(size, left[size])

    def _leave(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.open:
                self.open[gap] = []
                insort(self.gaps, gap)
            self.open[gap].append((first, n))

    def _put(self, size: int, first: int, offset: int, bins: int, each: int = 1) -> None:
        self.runs.append((size, self.next_rank[size], first, offset, each))
        self.next_rank[size] += bins * each

    def _match(self, left: dict[int, int]) -> None:
        """Bins of the pieces over a third, taken out of `left`."""
        large = sorted(s for s in left if 3 * s > self.capacity)
        while large:
            size = large.pop()
            n = left.pop(size)
            while n:
                if 2 * size <= self.capacity and n > 1:
                    bins, partner = n // 2, size
                else:
                    at = bisect_left(large, self.capacity - size + 1) - 1
                    partner = large[at] if at >= 0 else 0
                    bins = min(n, left[partner]) if partner else n
                self._put(size, self.bins, 0, bins)
                n -= bins
                if partner:
                    self._put(partner, self.bins, size, bins)
                    if partner == size:
                        n -= bins
                    else:
                        left[partner] -= bins
                        if not left[partner]:
                            del left[partner]
                            large.remove(partner)
                self._leave(self.capacity - size - partner, self.bins, bins)
                self.bins += bins

    def _fit(self, size: int, n: int) -> None:
        """Pieces of a size into the tightest gaps, then into new bins."""
        while n:
            at = bisect_left(self.gaps, size)
            if at < len(self.gaps):
                gap = self.gaps[at]
                first, bins = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap], self.gaps[at]
            else:
                gap, first, bins = self.capacity, self.bins, -(-n // (self.capacity // size))
                self.bins += bins
            each = gap // size
            full = min(bins, n // each)
            offset = self.capacity - gap
            if full:
                self._put(size, first, offset, full, each)
                self._leave(gap - each * size, first, full)
                n -= full * each
            if full < bins:
                if n:
                    self._put(size, first + full, offset, 1, n)
                    self._leave(gap - n * size, first + full, 1)
                    self._leave(gap, first + full + 1, bins - full - 1)
                    n = 0
                else:
                    self._leave(gap, first + full, bins - full)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Runs ordered by length and rank: a key of both, rank0, bin0, offset0, each."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << 48 | runs[:, 1], *runs[:, 1:].T)


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every whole text."""
    spark = docs.sparkSession
    made = stored(pieces(docs, path, end_id, capacity, text_col, id_col), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).arrays())  # runs grow with capacity, not with the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank0, bin0, offset0, each = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            step, within = np.divmod(rank - rank0[at], each[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bin0[at] + step), pa.array(offset0[at] + within * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(ahead, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
