"""Importance resampling towards a target distribution, over hashed n-gram counts.

Every text becomes a stream of uint16 bucket numbers, one per n-gram, packed in a binary cell of a stored
table; as a Parquet column such cells lie one after the other, so a batch read back is one packed
stream and the documents' offsets in it.  Counts of the corpus come from sorting each stretch of the stream
and its run lengths; they are added up by bucket, of which there are at most 65536.  The gains
of the buckets, the one table that travels, are then gathered along the stream and summed
between the offsets.  Gumbel noise from a hash of the id turns sums into a sample without replacement: the highest scores win.

Defined results: a null text has no features, no rank and weight 0; a text with fewer words than a feature's
takes the shorter runs only; equal scores go to the smaller doc_id, a null id last (it hashes as an empty string);
repeated rows are scored, counted and ranked one by one; very long texts are blocks of their own; an empty table gives
an empty result and an empty target makes every bucket's gain count against the corpus; other columns are passed over.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import forget, stored
from . import bytetext as bt

#: Bytes between words: all ASCII but digits and letters (A-Z are lowered first).
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Longer byte ranges get their checksum one by one.
LONG = 48

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of byte ranges, all at once: byte k of every range that has one, longest ranges first."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -LONG, "left") :]
    begin, size = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        state[:n] = _CRC[(state[:n] ^ data[begin[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    found = np.zeros(len(starts), np.uint32)
    found[order] = ~state
    for i in np.flatnonzero(lengths > LONG).tolist():
        found[i] = zlib.crc32(data[starts[i] : ends[i]])
    return found


def block_buckets(block: bt.Block, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all runs of 1 to `longest` words, where each text's begin, and each text's words."""
    data = bt.LOWER[block.data]
    words = bt.words(block, lower=True, gaps=GAP)
    n_words = np.diff(words.first)
    if longest == 1:
        return (crc32_spans(data, words.starts, words.ends) % buckets).astype("<u2"), words.first, n_words
    # a run of words is a byte range where they stand with one space between
    tight, starts, ends = bt.spaced(data, words.starts, words.ends)
    row, found, rows = words.row_of(), [], []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(starts))
        last = last[row[last] == row[last - n + 1]]
        found.append(crc32_spans(tight, starts[last - n + 1], ends[last]) % buckets)
        rows.append(row[last])
    rows_all = np.concatenate(rows)
    order = np.argsort(rows_all, kind="stable")
    return np.concatenate(found)[order].astype("<u2"), np.searchsorted(rows_all[order], np.arange(block.rows + 1)), n_words


def streams(texts: DataFrame, text_col: str = "text", id_col: str | None = "doc_id", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words and stream (packed uint16 buckets) of every row; without id_col the id is null."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"{buckets} buckets do not fit into 16 bits")
    name = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    source = texts.select(name.alias("doc_id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column("t")):
                found, first, n_words = block_buckets(block, longest, buckets)
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), block.rows, [None, pa.py_buffer((first * 2).astype("<i8").tobytes()), pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.lo, block.rows), pa.array(n_words), cells.cast(pa.binary())], ["doc_id", "n_words", "stream"])
        bt.release()

    return source.mapInArrow(run, "doc_id long, n_words long, stream binary")


def packed(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The stream of a batch of cells and the offset of each document in it (one more than documents)."""
    cells = cells.cast(pa.large_binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    held = cells.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data.view("<u2"), (offsets - offsets[0]) // 2


def counts(held: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in stored streams: stretches are sorted and run-length encoded, each task adds its own up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            ordered = np.sort(packed(batch.column("stream"))[0], kind="stable")
            edges = np.append(np.flatnonzero(np.diff(ordered, prepend=-1 if not len(ordered) else int(ordered[0]) - 1)), len(ordered))
            total[ordered[edges[:-1]]] += np.diff(edges)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    added = held.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in added.collect():  # a row per bucket
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    n, in_source, in_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * in_source / ((float(source[k]) + 1) * in_target))) for k in range(n)], np.int64)


def weighed(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the gains along each document's stream, summed between its offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = packed(batch.column("stream"))
            n = np.diff(first)
            weight = np.zeros(len(n), np.int64)
            filled = np.flatnonzero(n)
            if len(filled):  # reduceat takes an empty stretch for its first entry, so only others are asked for
                weight[filled] = np.add.reduceat(gain[found], first[:-1][filled])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return held.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: str) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of sha256(`seed:id`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked_first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Adds rank: 1, 2, 3... in the given order for the first `most` rows, null for the others.

    Rows are dealt by ranges of the order; one count per range travels, and each range numbers its own rows.
    """
    # stored once: bounds of ranges are sampled, so counts and numbers must come from the same partitions
    dealt = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    # a row per partition of the shuffle, so one task is enough
    ahead = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__ahead"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    place = (F.col("__ahead") + inner).cast("long")
    numbered = dealt.join(F.broadcast(ahead), "__part").withColumn("rank", place)
    return numbered.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("__part", "__ahead")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; drawn are the floor(percent * N / 100) best of the N with enough words."""
    held = stored(streams(docs, text_col, id_col, longest, buckets), "bucket-streams")
    aimed = stored(streams(target, text_col, None, longest, buckets), "target-streams")
    gain = gains(counts(held, buckets), counts(aimed, buckets))
    scored = stored(weighed(held, gain).withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    forget(held, aimed)
    enough = F.col("n_words") >= least_words
    most = percent * scored.filter(enough).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked_first(scored.filter(enough).select(*columns), [F.desc("score"), F.asc_nulls_last("doc_id")], most)
    return drawn.unionByName(scored.filter(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
