"""Token ids as wavelet matrices, one per shard.

A shard holds the ids of consecutive texts as bit planes, most significant first; each
plane orders the ids by the planes before it (zeros first, stably).  With the number of
ones before every block of 512 bits, one file answers: the token at a position (access),
how often a token occurs before a position (rank, count), where its k-th occurrence is
(select), and all ids (decode).  Planes are compressed in parts of PART_BYTES; a question unpacks the parts it touches.

File format, little-endian: magic "WVM2"; uint32 bits, texts; uint64 tokens; per text an
int64 id (with a validity byte) and a uint64 length; per plane uint64 zeros, uint32 parts, uint32 blocks + 1, uint32 ones
before each block, uint32 sizes of the parts, and the parts, each a zstd frame of big-endian bits.

Shards are rows of a Parquet table in the folder all executors share, so a lost
executor's shards are written again by the retried task and readers need no local path.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from ..operators.scratch import stored
from .word_ids import encoder

MAGIC = b"WVM2"
BLOCK_BITS = 512
PART_BYTES = 1 << 13
SHARD_TOKENS = 1 << 20


class Plane:
    """A bit plane: bits in big-endian bytes, compressed in parts that are unpacked when they are asked for; how many ones stand before each block."""

    def __init__(self, parts: list[bytes], ones: np.ndarray, zeros: int):
        self.parts, self.ones, self.zeros = parts, ones, zeros
        self.held: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, bit: np.ndarray) -> Plane:
        packed = np.packbits(bit)
        padded = np.zeros(-(-len(packed) // PART_BYTES) * PART_BYTES, np.uint8)
        padded[: len(packed)] = packed
        ones = np.zeros(len(padded) // (BLOCK_BITS // 8) + 1, np.uint32)
        np.cumsum(np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1), out=ones[1:])
        packer = zstandard.ZstdCompressor(level=1)
        return cls([packer.compress(padded[at : at + PART_BYTES].tobytes()) for at in range(0, len(padded), PART_BYTES)], ones, len(bit) - int(bit.sum()))

    def words(self, block: np.ndarray) -> np.ndarray:
        """[block, word] of the blocks, first bit highest."""
        found = np.zeros((len(block), BLOCK_BITS // 64), np.uint64)
        part, per = block * (BLOCK_BITS // 8) // PART_BYTES, PART_BYTES * 8 // BLOCK_BITS
        for p in np.unique(part).tolist():
            if p >= len(self.parts):
                continue
            if p not in self.held:
                self.held[p] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.parts[p]), ">u8").astype(np.uint64).reshape(per, -1)
            here = part == p
            found[here] = self.held[p][block[here] - p * per]
        return found

    def ranks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each position, and the ones before it."""
        block, inside = at // BLOCK_BITS, at % BLOCK_BITS
        words = self.words(block)
        word, bit = inside // 64, (inside % 64).astype(np.uint64)
        own = words[np.arange(len(at)), word]
        counts = np.where(np.arange(words.shape[1]) < word[:, None], np.bitwise_count(words), 0).sum(axis=1, dtype=np.int64)
        ahead = np.where(bit > 0, np.bitwise_count(own >> (np.uint64(64) - np.maximum(bit, np.uint64(1)))), 0)
        return (own >> (np.uint64(63) - bit) & np.uint64(1)).astype(bool), self.ones[block].astype(np.int64) + counts + ahead

    def select(self, one: bool, k: int) -> int:
        """Position of the k-th one (or zero), from 0: its block by the counts, then its place in the block."""
        before = self.ones.astype(np.int64) if one else np.arange(len(self.ones)) * BLOCK_BITS - self.ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.words(np.array([block])).astype(">u8").view(np.uint8))
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[k - before[block]])

    def bits(self, n: int) -> np.ndarray:
        unpacker = zstandard.ZstdDecompressor()
        return np.unpackbits(np.frombuffer(b"".join(map(unpacker.decompress, self.parts)), np.uint8), count=n).view(bool)


class WaveletMatrix:
    """Bit planes of n ids, most significant first; each orders the ids by the planes before it, zeros first."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes, self.bits = n, planes, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
            raise ValueError(f"ids from {ids.min()} to {ids.max()} do not fit into {bits} bits")
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits):
            bit = (now & now.dtype.type(1 << (bits - 1 - level))) != 0
            planes.append(Plane.of(bit))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(ids), planes)

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(positions, np.int64)
        found = np.zeros(len(at), np.int64)
        for plane in self.planes if len(at) else []:
            bit, ones = plane.ranks(at)
            found = found << 1 | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return found

    def _ranges(self, token: int, positions: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the token's ids begin below the last plane, and where those before each position end there."""
        at = np.append(np.asarray(positions, np.int64), 0)
        for level, plane in enumerate(self.planes):
            ones = plane.ranks(at)[1]
            at = plane.zeros + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        return int(at[-1]), at[:-1]

    def rank(self, token: int, positions: np.ndarray) -> np.ndarray:
        """How often the token occurs before each position."""
        if not self.n or token >> self.bits:
            return np.zeros(len(positions), np.int64)
        first, ends = self._ranges(token, positions)
        return ends - first

    def count(self, token: int) -> int:
        return int(self.rank(token, np.array([self.n]))[0])

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0; -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        at = self._ranges(token, np.zeros(0, np.int64))[0] + k
        for level in range(self.bits - 1, -1, -1):
            plane, one = self.planes[level], bool(token >> (self.bits - 1 - level) & 1)
            at = plane.select(one, at - plane.zeros if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: access for every position, plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = self.planes[level].bits(self.n)
            before = np.empty(self.n, kind)
            before[~bit] = now[: self.planes[level].zeros]
            before[bit] = now[self.planes[level].zeros :] | kind(1 << (self.bits - 1 - level))
            now = before
        return now


def to_file(matrix: WaveletMatrix, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray) -> bytes:
    head = MAGIC + struct.pack("<IIQ", matrix.bits, len(lengths), matrix.n) + doc_ids.astype("<i8").tobytes() + valid.astype(np.uint8).tobytes() + lengths.astype("<u8").tobytes()
    body = []
    for plane in matrix.planes:
        body.append(struct.pack("<QII", plane.zeros, len(plane.parts), len(plane.ones)) + plane.ones.astype("<u4").tobytes() + np.array([len(p) for p in plane.parts], "<u4").tobytes())
        body += plane.parts
    return head + b"".join(body)


def from_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, doc ids, which of these are not null, and lengths; planes stay compressed."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    bits, texts, n = struct.unpack_from("<IIQ", data, 4)
    at = 20
    doc_ids = np.frombuffer(data, "<i8", texts, at)
    valid = np.frombuffer(data, np.uint8, texts, at + 8 * texts).astype(bool)
    lengths = np.frombuffer(data, "<u8", texts, at + 9 * texts).astype(np.int64)
    at += 17 * texts
    planes = []
    for _ in range(bits):
        zeros, n_parts, n_ones = struct.unpack_from("<QII", data, at)
        ones = np.frombuffer(data, "<u4", n_ones, at + 16)
        sizes = np.frombuffer(data, "<u4", n_parts, at + 16 + 4 * n_ones).tolist()
        at += 16 + 4 * (n_ones + n_parts)
        parts = []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        planes.append(Plane(parts, ones, zeros))
    return WaveletMatrix(n, planes), doc_ids, valid, lengths


def write_shards(docs: DataFrame, path: str, end_id: int, bits: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes every whole text plus the end id and stores them as shards in ascending doc_id order (null ids first).

    Returns the stored table: part (a range of ids), start (tokens of the part before the shard), n_tokens, shard (the file).
    A shard holds whole texts: at least SHARD_TOKENS tokens, but for the part's last. Without `bits` the planes are as many as
    the vocabulary and the end id need; an id that does not fit is an error.
    """
    bits = bits or max(encoder(path).tokenizer.get_vocab_size() - 1, end_id).bit_length()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    # many rows may have one id, or none: the text's beginning cuts them apart in the order of the sort
    ordered = source.repartitionByRange("doc_id", F.substring("__text", 1, 32)).sortWithinPartitions("doc_id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        n_held = 0

        def shard() -> pa.RecordBatch:
            ids, lengths, doc_ids, valid = (np.concatenate([h[k] for h in held]) for k in range(4))
            data = to_file(WaveletMatrix.build(ids, bits), doc_ids, valid, lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "start", "n_tokens", "shard"])

        for batch in batches:
            for block in bt.blocks(batch.column("__text")):
                ids, first = encoder(path).encode(block)
                ids = np.insert(ids, first[1:], end_id)
                doc_ids = batch.column("doc_id").slice(block.lo, block.rows)
                held.append((ids, np.diff(first) + 1, doc_ids.fill_null(0).to_numpy(zero_copy_only=False), ~doc_ids.is_null().to_numpy(zero_copy_only=False)))
                n_held += len(ids)
                if n_held >= SHARD_TOKENS:
                    yield shard()
                    start, n_held, held = start + n_held, 0, []
        if n_held:
            yield shard()

    return stored(ordered.mapInArrow(run, "part int, start long, n_tokens long, shard binary"), "wavelet-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all texts before), n_tokens and ids_crc32 of each text, decoded from the shards; last_id by
    access, and n_last, how often that id occurs in the text, by rank."""
    # one number for each part; how many parts there are is a setting of the shuffle, not of the corpus
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, ahead = {}, 0
    for part, n in totals:
        base[part] = ahead
        ahead += n
    shared = shards.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("shard"), strict=True):
                matrix, doc_ids, valid, lengths = from_file(data.as_py())
                ids = memoryview(np.ascontiguousarray(matrix.decode().astype("<u4"))).cast("B")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                last = matrix.access(ends - 1)
                n_last = np.zeros(len(ends), np.int64)
                for token in np.unique(last).tolist():
                    of = np.flatnonzero(last == token)
                    n_last[of] = np.subtract(*matrix.rank(token, np.concatenate([ends[of], (ends - lengths)[of]])).reshape(2, -1))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~valid), pa.array(ends - lengths + start + shared.value[part]), pa.array(lengths), pa.array(np.array(crc, np.int64)), pa.array(last), pa.array(n_last)], ["doc_id", "start", "n_tokens", "ids_crc32", "last_id", "n_last"])

    return shards.select("part", "start", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long, n_last long")
