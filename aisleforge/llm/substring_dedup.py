"""Substring deduplication: passages of `length` words that an earlier document holds too are removed, by FM-indexes.

A text falls into stretches: runs of neighbouring windows of `length` words that have the same anchor, the run of `GRAM` words
in the window with the least hash.  Equal windows have equal anchors wherever they stand, so anchors deal windows
to shards, and only an anchor that several documents hold can matter.  Equal stretches are one from the first shuffle on.
A shard holds the distinct stretches of some anchors: it builds their FM-index, streams them through it, and the
matching statistics (`fm_index.FmIndex.statistics`) report for each window the earliest document that holds it.
These answers go back to all documents with the stretch, and each removes the words of windows that an earlier one holds.

An anchor with one distinct stretch needs no index, as it is answered by the stretch's earliest document.  One with more than CROWD (the
edges of a passage that very many documents quote) would overfill its shard; its windows are grouped by 128-bit hashes instead,
which is exact as well and splits over all tasks.

Defined results: a null or empty text has no words and keeps none (sha256 of nothing); texts under `length` words keep all; very
long texts are blocks of their own; equal words at different places count one by one; rows of one doc_id do not remove each other's words, repeated rows
get the same answer each; null ids come after all others and do not remove each other's words; an empty table gives an
empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import forget, joined_apart, stored
from . import bytetext as bt
from .fm_index import FmIndex

GRAM = 16
#: Stretches that a shard holds, and distinct stretches of one anchor up to which they go to one shard.
SHARD, CROWD = 8192, 1024

_OTHER = np.uint64(0x94D049BB133111EB)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    found, size = values, 1
    while 2 * size <= width:
        found, size = np.minimum(found[:-size], found[size:]), 2 * size
    return np.minimum(found[: len(values) - width + 1], found[width - size :]) if width > size else found


def stretches(words: bt.Spans, length: int) -> dict[str, np.ndarray]:
    """Row, first window (in its text), number of windows, anchor and 128-bit hash of each stretch of the texts."""
    n, width = len(words.starts), length - GRAM + 1
    counts = np.diff(words.first)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("row", "at", "n", "g", "s1", "s2")}
    begin = np.arange(n - GRAM + 1)
    least = _least(bt.hash_ranges(words.hashes, begin, begin + GRAM), width)
    made = np.maximum(counts - length + 1, 0)
    ahead = np.cumsum(made) - made
    row = np.repeat(np.arange(len(counts)), made)
    window = np.arange(len(row)) + (words.first[:-1] - ahead)[row]
    anchor = least[window]
    fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    # periodic texts have one anchor for ever; cut, their stretches are equal again
    since = np.arange(len(row)) - np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
    first = np.flatnonzero(since % width == 0)
    size = np.diff(np.append(first, len(row)))
    start = window[first]
    end = start + size + length - 1
    s1, s2 = bt.hash_ranges(words.hashes, start, end), bt.hash_ranges(bt.mix(words.hashes ^ _OTHER), start, end)
    return {"row": row[first], "at": start - words.first[:-1][row[first]], "n": size, "g": anchor[first].view(np.int64), "s1": s1.view(np.int64), "s2": s2.view(np.int64)}


def _runs(source: DataFrame, length: int) -> DataFrame:
    """id, h, at, n, g, s1, s2: one row for each stretch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column("t")):
                found = stretches(bt.words(block, lower=False), length)
                of = pa.array(found["row"] + block.lo)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("h").take(of), pa.array(found["at"]), pa.array(found["n"]), *(pa.array(found[k]) for k in ("g", "s1", "s2"))], ["id", "h", "at", "n", "g", "s1", "s2"])
        bt.release()

    return source.select("id", "h", "t").mapInArrow(run, "id long, h long, at long, n long, g long, s1 long, s2 long")


def _cut(source: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """g, s1, s2, first, crowd, n and words (64-bit hashes, packed) of the wanted stretches, out of the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column("t")):
                words = bt.words(block, lower=False)
                cells = batch.column("wanted").slice(block.lo, block.rows)
                flat = cells.flatten()
                begin = np.repeat(words.first[:-1], cells.value_lengths().to_numpy()) + flat.field("at").to_numpy()
                end = begin + flat.field("n").to_numpy() + length - 1
                if (bt.hash_ranges(words.hashes, begin, end).view(np.int64) != flat.field("s1").to_numpy()).any():
                    raise RuntimeError("a stretch is not where its text was said to hold it")
                held = [words.hashes[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in ("g", "s1", "s2", "first", "crowd", "n")), pa.array(held, pa.binary())], ["g", "s1", "s2", "first", "crowd", "n", "words"])
        bt.release()

    by_text = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("g", "s1", "s2", F.col("id").alias("first"), "crowd", "at", "n")).alias("wanted"))
    return source.select("id", "h", "t").join(by_text, ["id", "h"]).select("t", "wanted").mapInArrow(run, "g long, s1 long, s2 long, first long, crowd boolean, n long, words binary")


def _searched(held: DataFrame, shards: int, length: int) -> DataFrame:
    """g, s1, s2, first and firsts (per window the earliest document) of stretches: each shard's go through its FM-index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = np.stack([rows.column(k).to_numpy() for k in ("g", "s1", "s2")], axis=1)
        once = np.sort(np.unique(keys, axis=0, return_index=True)[1])  # repeated rows of a text bring its stretches again
        rows = rows.take(pa.array(once))
        cells = [c.as_py() for c in rows.column("words")]
        words, sizes = np.frombuffer(b"".join(cells), np.uint64), np.array([len(c) // 8 for c in cells])
        index = FmIndex(words, sizes, rows.column("first").to_numpy(), length)
        mark = index.statistics(words, sizes)[1]
        n = rows.column("n").to_numpy()
        at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        firsts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(mark[at]))
        yield pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks() for k in ("g", "s1", "s2", "first")), firsts], ["g", "s1", "s2", "first", "firsts"])
        bt.release()

    return held.repartition(shards, "g").select("g", "s1", "s2", "first", "n", "words").mapInArrow(run, "g long, s1 long, s2 long, first long, firsts array<long>")


def _grouped(held: DataFrame, length: int) -> DataFrame:
    """As `_searched`, for anchors with very many stretches: each window's earliest document by its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            cells = [c.as_py() for c in batch.column("words")]
            words, sizes = np.frombuffer(b"".join(cells), np.uint64), np.array([len(c) // 8 for c in cells], np.int64)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(np.cumsum(sizes) - sizes, n) + k
            of = pa.array(np.repeat(np.arange(len(n)), n))
            w1, w2 = bt.hash_ranges(words, begin, begin + length), bt.hash_ranges(bt.mix(words ^ _OTHER), begin, begin + length)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("g", "s1", "s2", "first")), pa.array(k), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], ["g", "s1", "s2", "first", "k", "w1", "w2"])

    windows = stored(held.select("g", "s1", "s2", "first", "n", "words").mapInArrow(run, "g long, s1 long, s2 long, first long, k long, w1 long, w2 long"), "crowded-windows")
    least = stored(windows.groupBy("w1", "w2").agg(F.min("first").alias("least")), "crowded-firsts")
    met = joined_apart(windows, least, "w1", "w2").groupBy("g", "s1", "s2", "first").agg(F.array_sort(F.collect_set(F.struct("k", "least"))).alias("x"))
    return met.select("g", "s1", "s2", "first", F.col("x.least").alias("firsts"))


def repeats(source: DataFrame, length: int) -> DataFrame:
    """id, h and starts: the windows (first words) of each text that a text of a smaller id holds too.

    source: id (no nulls), h (64-bit hash of the text) and t (the text).
    """
    runs = stored(_runs(source, length), "stretches")
    distinct = stored(runs.groupBy("g", "s1", "s2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("h", "id").alias("h"), F.min_by("at", "id").alias("at"), F.first("n").alias("n")), "distinct-stretches")
    anchors = distinct.groupBy("g").agg(F.count("*").alias("d"), F.min("first").alias("a"), F.max("last").alias("b")).filter("a < b").select("g", "d")
    shared = stored(joined_apart(distinct, anchors, "g"), "shared-stretches")
    several = shared.filter("d > 1").select("g", "s1", "s2", F.col("first").alias("id"), "h", "at", "n", (F.col("d") > CROWD).alias("crowd"))
    cut = stored(_cut(source, several, length), "cut-stretches")
    n = cut.filter("NOT crowd").count()
    answers = _searched(cut.filter("NOT crowd"), max(1, -(-n // SHARD)), length).unionByName(_grouped(cut.filter("crowd"), length))
    answers = stored(answers.unionByName(shared.filter("d = 1").select("g", "s1", "s2", "first", F.lit(None).cast("array<long>").alias("firsts"))), "answers")
    forget(distinct, shared, cut)
    every = F.when(F.col("first") < F.col("id"), F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))
    some = F.filter(F.transform("firsts", lambda x, k: F.when(x < F.col("id"), F.col("at") + k)), lambda x: x.isNotNull())
    hit = joined_apart(runs.select("id", "h", "at", "n", "g", "s1", "s2"), answers, "g", "s1", "s2").select("id", "h", F.when(F.col("firsts").isNull(), every).otherwise(some).alias("starts"))
    # a set: rows repeated whole bring the same stretches again
    return hit.filter(F.size("starts") > 0).groupBy("id", "h").agg(F.flatten(F.collect_set("starts")).alias("starts"))


def dedup(docs: DataFrame, length: int = 50, text_col: str = "text", id_col: str = "doc_id", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document and, with `texts`, kept: its kept words joined by one space."""
    if length < 2 * GRAM:
        raise ValueError(f"passages must have {2 * GRAM} words at least")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a null id takes the last place
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column("t")):
                words = bt.words(block, lower=False)
                cells = batch.column("starts").slice(block.lo, block.rows)
                sizes = cells.value_lengths().fill_null(0).to_numpy()
                begin = np.repeat(words.first[:-1], sizes) + cells.flatten().to_numpy()
                change = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                n_words, n_kept = np.diff(words.first), bt.sums(kept.astype(np.int64), words.first)
                tight, starts, ends = bt.spaced(block.data, words.starts[kept], words.ends[kept])
                held = tight.tobytes()
                last = np.cumsum(n_kept)
                rest = [held[starts[b - n] : ends[b - 1]] if n else b"" for b, n in zip(last.tolist(), n_kept.tolist(), strict=True)]
                columns = [batch.column("doc_id").slice(block.lo, block.rows), pa.array(n_words), pa.array(n_words - n_kept), pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.decode() for x in rest], pa.string())] if texts else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])])
        bt.release()

    joined = source.join(repeats(source, length), ["id", "h"], "left").select("doc_id", "t", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else ""))
