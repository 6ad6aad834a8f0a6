"""Near-duplicate classes by b-bit MinHash.

1. Every text becomes the set of hashes of its distinct word shingles.  Texts with equal
   sets form one class, found by a 128-bit sum over the set, so copies cost one row each.
2. Of BANDS * ROWS minima a class keeps band keys (ROWS whole minima hashed together) and the
   low LOW_BITS bits of every minimum, packed into longs.
3. Candidates share a band.  The share of equal packed bits, corrected for the
   1 / 2**LOW_BITS of other minima that agree by chance, estimates their similarity; bit counts
   on XORed longs give it.  Pairs far below the threshold go no further.
4. What remains is confirmed on the full sets: 100 * |intersection| >= percent * |union|.

No bucket is expanded into its pairs.  First every class is confirmed against the one bucket
end (smallest or largest class id of a shared bucket) that it resembles most.  Then only buckets
that still hold several components are searched: members outside the bucket's largest
component against all its members, in blocks of bounded size, in which numpy compares the packed
bits.  In ROUNDS rounds each such member is confirmed against the one member of another
component that it resembles most, which joins groups whose members resemble each other but not all one
member.  A last search examines every pair that may reach the threshold and whose
classes are not connected by then, so nothing is left out, whatever a bucket's size.  Members of
buckets with more than SMALL members get a wider signature (WIDE minima) for it, and such a pair is returned
only from the first band it shares and only if the wider estimate still allows the
threshold: else a group of texts just below it would be returned pair by pair.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**ROWS) ** BANDS = 3e-8.

Defined results: a null text counts as empty; a text without words has no set, links with
nothing and is its own component; repeated rows are copies of each other; a null id
never becomes a component's id unless the component has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from ..operators.components import connected_components
from ..operators.scratch import forget, joined_apart, stored

SHINGLE = 5
ROWS, BANDS, LOW_BITS = 5, 64, 2
_HASHES = ROWS * BANDS
_PER_LONG = 64 // LOW_BITS
_LONGS = _HASHES // _PER_LONG
#: How far below the threshold an estimate may lie: 5.5 standard deviations of _HASHES draws at 0.75.
SLACK = 0.16
CHUNK = 512
STAR = 64
#: Of a block of texts to be signed; their minima take several times as much.
BLOCK_BYTES = 1 << 20
ROUNDS = 1
SMALL = 64
#: Minima of the wider signature, and its slack: 5.5 standard deviations.
WIDE, WIDE_SLACK = 2048, 0.065

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WIDE_XOR = _rng.integers(0, 1 << 32, WIDE, dtype=np.uint32)
_WIDE_TIMES = _rng.integers(0, 1 << 31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_SALT = bt.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(block: bt.Block) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, and where each text's begin."""
    hashes, first = bt.windows(bt.words(block, lower=True), SHINGLE, whole_if_short=True)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[first[:-1][np.diff(first) > 0]] = True
    return hashes[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


def minima(hashes: np.ndarray, first: np.ndarray, xor: np.ndarray = _XOR, times: np.ndarray = _TIMES) -> np.ndarray:
    """[text, hash function] of the texts that have shingles."""
    begins = first[:-1][np.diff(first) > 0]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.empty((len(xor), len(begins)), np.uint32)
    if len(begins):
        work = np.empty_like(short)
        for k in range(len(xor)):
            np.bitwise_xor(short, xor[k], out=work)
            np.multiply(work, times[k], out=work)
            np.minimum.reduceat(work, begins, out=found[k])
    return found.T


def band_keys(mins: np.ndarray) -> np.ndarray:
    wide = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(_BAND_SALT, (len(mins), BANDS)).copy()
    for k in range(ROWS):
        keys = (keys ^ wide[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(32)
    return bt.mix(keys).view(np.int64)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    low = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(32 - LOW_BITS)).astype(np.uint64).reshape(len(mins), mins.shape[1] // _PER_LONG, _PER_LONG)
    return np.bitwise_or.reduce(low << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(LOW_BITS)), axis=2).view(np.int64)


def similarity(equal: Column) -> Column:
    """Similarity from how many of the packed minima are equal, less those equal by chance."""
    by_chance = 1 / (1 << LOW_BITS)
    return (equal / F.lit(float(_HASHES)) - by_chance) / (1 - by_chance)


def _least_equal(percent: int, hashes: int = _HASHES, slack: float = SLACK) -> int:
    """Equal packed minima from which a pair is confirmed on full sets."""
    by_chance = 1 / (1 << LOW_BITS)
    return int(np.floor(hashes * (by_chance + (1 - by_chance) * max(0.0, percent / 100 - slack))))


def _equal(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """[left, right]: equal packed minima of two stacks of signatures."""
    differ = np.zeros((len(sa), len(sb)), np.int64)
    for k in range(sa.shape[1]):
        x = sa[:, k, None] ^ sb[None, :, k]
        differ += np.bitwise_count((x | x >> 1) & np.int64(_ODD_BITS))
    return sa.shape[1] * _PER_LONG - differ


_SIGS = [f"s{k}" for k in range(_LONGS)]
_ODD_BITS = sum(1 << k for k in range(0, 64, LOW_BITS))
_ODD_BITS = _ODD_BITS - (1 << 64) if _ODD_BITS >= 1 << 63 else _ODD_BITS


def signatures(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, text_key, n_shingles, f1, f2 (the set's sums), bands, s0.. (packed bits) of each row."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column("__text"), BLOCK_BYTES):
                hashes, first = shingle_sets(block)
                mins = minima(hashes, first)
                filled = np.diff(first) > 0
                bands = np.zeros((block.rows, BANDS), np.int64)
                bands[filled] = band_keys(mins)
                bits = np.zeros((block.rows, _LONGS), np.int64)
                bits[filled] = packed_bits(mins)
                kept = batch.slice(block.lo, block.rows)
                sums = [bt.sums(bt.mix(hashes + np.uint64(k)), first).view(np.int64) for k in (1, 2)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, block.rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("text_key"), pa.array(np.diff(first)), *map(pa.array, sums), lists, *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(_LONGS))], ["doc_id", "text_key", "n_shingles", "f1", "f2", "bands", *_SIGS])
        bt.release()

    return source.mapInArrow(run, "doc_id long, text_key long, n_shingles long, f1 long, f2 long, bands array<long>, " + ", ".join(f"{s} long" for s in _SIGS))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; texts: (cls, text).

    Many pairs may share their b, so its text goes once to each block of about STAR partners, and blocks are dealt out apart.
    """
    blocks_of = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("blocks"))
    dealt = joined_apart(pairs, blocks_of, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    partners = dealt.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").groupBy("b", "block").agg(F.collect_list(F.struct("a", "ta")).alias("partners"))
    ends = texts.join(blocks_of, texts.cls == blocks_of.b).select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("text").alias("tb"))

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for block in bt.blocks(column):
            hashes, first = shingle_sets(block)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield hashes[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, right in enumerate(sets(batch.column("tb"))):
                held = batch.column("partners")[row].values
                keep = []
                for left in sets(held.field("ta")):
                    both = np.concatenate([left, right])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(100 * common >= percent * (len(left) + len(right) - common))
                ends = pa.array(np.full(len(held), batch.column("b")[row].as_py()))
                yield pa.RecordBatch.from_arrays([held.field("a"), ends], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        bt.release()

    return partners.join(ends, ["b", "block"]).select("b", "partners", "tb").mapInArrow(run, "a long, b long")


def _mixed(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, cls) of the buckets that hold several components, with root, main (the largest one's root), total and chunk."""
    rooted = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("total"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("parts > 1")
    held = rooted.join(mixed, "key").join(classes.select("cls", "n_shingles", *_SIGS), "cls")
    return stored(held.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.ceil(F.col("total") / CHUNK))), "mixed-buckets")


def _met(held: DataFrame, packed: Column) -> DataFrame:
    """key, left, right: each chunk of members outside the main component beside each chunk of all members of its bucket.

    Pairs of chunks are dealt out by bucket and right chunk, so a large bucket is not one task's.
    """
    everyone = held.groupBy("key", "chunk").agg(F.collect_list(packed).alias("right"))
    outside = held.filter("root <> main").groupBy("key", "chunk").agg(F.collect_list(packed).alias("left"), F.max("total").alias("total"))
    facing = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / CHUNK) - 1))
    return outside.select("key", "left", facing.alias("chunk")).join(everyone, ["key", "chunk"]).select("key", "left", "right")


def _likely_pairs(held: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, equal): the members' pairs of different components that may reach the threshold by their signatures.

    With `best` for each left member of a batch only the likeliest.
    """
    least = _least_equal(percent)

    def columns(rows: pa.StructScalar) -> tuple[np.ndarray, ...]:
        flat = rows.values
        of = {n: np.asarray(flat.field(n)) for n in ("cls", "root", "n_shingles", *_SIGS)}
        return of["cls"], of["root"], of["n_shingles"], np.stack([of[s] for s in _SIGS], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 3]
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a, ra, na, sa = columns(left)
                b, rb, nb, sb = columns(right)
                for lo in range(0, len(a), 64):
                    part = slice(lo, lo + 64)
                    small, large = np.minimum(na[part, None], nb[None, :]), np.maximum(na[part, None], nb[None, :])
                    equal = np.where((ra[part, None] != rb[None, :]) & (100 * small >= percent * large), _equal(sa[part], sb), 0)
                    if best:
                        j = equal.argmax(axis=1)
                        i = np.flatnonzero(equal[np.arange(len(j)), j] >= least)
                        j = j[i]
                    else:
                        i, j = np.nonzero(equal >= least)
                    found.append((a[lo + i], b[j], equal[i, j].astype(np.int64)))
            a, b, equal = (np.concatenate(x) for x in zip(*found, strict=True))
            if best:
                order = np.lexsort((b, equal, a))
                order = order[np.append(np.diff(a[order]) != 0, True)] if len(order) else order
                a, b, equal = a[order], b[order], equal[order]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(equal)], ["a", "b", "equal"])

    packed = F.struct("cls", "root", "n_shingles", *_SIGS)
    return _met(held, packed).select("left", "right").mapInArrow(run, "a long, b long, equal long")


def _wide_pairs(held: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that may reach the threshold by their wide signatures (cls, wide, marks), from the first band they share."""
    least = _least_equal(percent, WIDE, WIDE_SLACK)

    def columns(rows: pa.StructScalar) -> tuple[np.ndarray, ...]:
        flat = rows.values
        lists = [np.asarray(flat.field(n).flatten()).reshape(len(flat), -1) for n in ("wide", "marks")]
        return np.asarray(flat.field("cls")), np.asarray(flat.field("root")), *lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 2]
            for key, left, right in zip(batch.column("key").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                a, ra, wa, ma = columns(left)
                b, rb, wb, mb = columns(right)
                for lo in range(0, len(a), 16):
                    part = slice(lo, lo + 16)
                    i, j = np.nonzero((ra[part, None] != rb[None, :]) & (_equal(wa[part], wb) >= least))
                    i = lo + i
                    same = ma[i] == mb[j]
                    ours = ma[i, same.argmax(axis=1)] == key if len(i) else np.zeros(0, bool)
                    found.append((np.minimum(a[i], b[j])[ours], np.maximum(a[i], b[j])[ours]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return _met(held.join(wide, "cls"), F.struct("cls", "root", "wide", "marks")).mapInArrow(run, "a long, b long")


def _wide_signatures(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, wide (packed bits of WIDE minima), marks (the band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # WIDE minima a text take more than the text, so fewer texts at a time than for the narrow signature
            for block in bt.blocks(batch.column("text"), BLOCK_BYTES * _HASHES // WIDE):
                hashes, first = shingle_sets(block)
                bits = packed_bits(minima(hashes, first, _WIDE_XOR, _WIDE_TIMES))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, WIDE // _PER_LONG, dtype=np.int32)), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(block.lo, block.rows), lists], ["cls", "wide"])
        bt.release()

    made = texts.select("cls", "text").mapInArrow(run, "cls long, wide array<long>")
    return made.join(classes.select("cls", F.col("bands").alias("marks")), "cls")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classified(docs: DataFrame, percent: int = 75, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_key, n_shingles, component, component_id of each row of docs.

    component numbers the components of this run, component_id is the smallest id of one's rows, which
    another one may have too where ids repeat.
    """
    signed = stored(signatures(docs, text_col, id_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    groups = stored(signed.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least_id")), "classes")
    classes = stored(signed.join(groups.select(F.col("cls").alias("row")), "row").withColumnRenamed("row", "cls").select("cls", "doc_id", "text_key", "n_shingles", "bands", *_SIGS), "class-signatures")

    banded = classes.select("cls", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high")).filter("n > 1")
    members = stored(banded.join(shared, "key").select("key", "cls", "low", "high"), "shared-bands")

    # the bucket end that each class resembles most
    tried = members.select("cls", F.explode(F.array("low", "high")).alias("end")).filter("cls <> end").distinct()
    mine, theirs = classes.select("cls", *_SIGS), classes.select(F.col("cls").alias("end"), *(F.col(s).alias(f"e{s}") for s in _SIGS))
    differ = sum((F.bit_count((F.col(s).bitwiseXOR(F.col(f"e{s}")).bitwiseOR(F.shiftright(F.col(s).bitwiseXOR(F.col(f"e{s}")), 1))).bitwiseAND(F.lit(_ODD_BITS))) for s in _SIGS), F.lit(0))
    rated = tried.join(mine, "cls").join(theirs, "end").select("cls", "end", (F.lit(_HASHES) - differ).alias("equal"))
    likely = rated.filter(F.col("equal") >= _least_equal(percent)).groupBy("cls").agg(F.max_by("end", F.struct("equal", "end")).alias("end"))
    # as chosen, for an end that many classes choose is read once for many of them; of two that chose each other one pair
    chosen = likely.select(F.col("cls").alias("a"), F.col("end").alias("b"))
    pairs = stored(chosen.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).groupBy("x", "y").agg(F.min_by("a", "a").alias("a"), F.min_by("b", "a").alias("b")), "pairs")

    # texts of the classes that share a band with another one; all confirmation reads this table
    texts = _texts(docs, classes, members.select("cls").distinct(), text_col, id_col)
    links = stored(_confirmed(pairs.select("a", "b"), texts, percent), "confirmed")
    roots = connected_components(links)
    tried, shared_by = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), members.select("key", "cls")

    def confirmed_too(found: DataFrame) -> bool:
        nonlocal links, roots, tried
        more = stored(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            return False
        late = stored(_confirmed(more, texts, percent), "confirmed")
        tried = tried.unionByName(more)
        if late.isEmpty():
            return False
        links = links.unionByName(late)
        roots = connected_components(links)
        return True

    used = []
    for _ in range(ROUNDS):
        used.append(_mixed(shared_by, classes, roots))
        best = _likely_pairs(used[-1], percent, best=True).groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
        if not confirmed_too(_ordered(best)):
            break
    held = _mixed(shared_by, classes, roots)
    rest = _ordered(_likely_pairs(held.filter(F.col("total") <= SMALL), percent, best=False))
    crowded = held.filter(F.col("total") > SMALL)
    if not crowded.isEmpty():
        used.append(stored(_wide_signatures(texts.join(crowded.select("cls").distinct(), "cls"), classes), "wide-signatures"))
        rest = _ordered(rest.unionByName(_wide_pairs(crowded, used[-1], percent)))
    confirmed_too(rest)
    forget(held, texts, members, classes, pairs, *used)

    rooted = stored(groups.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = joined_apart(rooted, ids, "root").select("f1", "f2", F.col("root").alias("component"), "component_id")
    # rows without words meet nothing and are spread by their numbers
    rows = joined_apart(signed.filter("n_shingles > 0"), named, "f1", "f2")
    alone = signed.filter("n_shingles = 0").withColumns({"component": F.col("row"), "component_id": F.col("doc_id")})
    columns = ["doc_id", "text_key", "n_shingles", "component", "component_id"]
    return rows.select(*columns).unionByName(alone.select(*columns)).withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, percent: int = 75, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    found = classified(docs, percent, text_col, id_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, percent: int = 75, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of docs for each component: that with the smallest id (null last), of rows with one id that with the smallest hash of its text.

    Of rows with equal id and text one stays, whether they have words or not.
    """
    found = classified(docs, percent, text_col, id_col)
    key = {"__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__key": F.xxhash64(F.col(text_col).cast("string"))}
    names = list(key)
    order = F.struct(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_key").alias("__key"))
    kept = found.groupBy("component").agg(F.min(order).alias("x")).select("x.*").distinct()
    # the row travels as one column, so that no column of docs can clash with the keys
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in key.items())).groupBy(*names).agg(F.first("row").alias("row"))
    return rows.join(kept, names, "left_semi").select("row.*")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(cls, text) of the wanted classes."""
    chosen = classes.join(wanted, "cls").select("cls", F.col("doc_id").alias("__id"), "text_key")
    text = F.col(text_col).cast("string")
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    met = held.join(chosen, (held.text_key == chosen.text_key) & held.doc_id.eqNullSafe(F.col("__id")))
    # repeated rows are one class
    return stored(met.select("cls", "text").dropDuplicates(["cls"]), "pair-texts")
