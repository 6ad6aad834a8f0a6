"""Language-model scoring by context-tree weighting over bytes.

A text is modelled as its words, A-Z lower-cased, joined by single spaces and closed by
an end symbol (byte 0xFF, which UTF-8 never holds; it also stands before the text).  A byte
is eight binary decisions.  Each decision has a context tree over the last DEPTH bytes; every
node holds a Krichevsky-Trofimov estimator, and a node's weighted probability mixes its own
estimate with the product of its children's, one half each.  So all depths take part, weighted
by how well they foretold the training texts.

The counts are those of all (DEPTH + 1)-grams of all training texts.  Trees are built level by
level with grouped sums (a parent sums its at most 256 children) and the mixture is carried
down again with joins, in SQL functions only.  The model then is a table: a log probability for each gram that
occurs anywhere.  It grows with the corpus and is never collected.

Scoring reads every whole text once more.  The most frequent words and grams (at most
HEAD_WORDS and HEAD_GRAMS of them, found by a histogram of counts) are broadcast; the others are
joined by key.  As frequent keys never reach that join, it has no hot keys.

Base score: the unigram model over words and one end per text, smoothed by 0.1.

Defined results: a null text counts as empty (just the end); a null id is not held out; repeated rows
count, and are scored, as often as they occur; without training texts every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from ..operators.scratch import forget, stored

DEPTH = 5
END = 0xFF
HEAD_WORDS = 1 << 17
HEAD_GRAMS = 1 << 20
WORD, GRAM = 0, 1
#: The key of a text's end among the words.
END_KEY = np.uint64(0x5E4D_3C2B_1A09_F8E7)
_MERGE_AT = 1 << 21
#: Of a block; a gram takes eight times the bytes of its text.
BLOCK_BYTES = 1 << 20
#: Input from which a counting task is large enough.
TASK_BYTES = 4 << 20


def held_out(doc_id: Column, parts: int = 10) -> Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def grams(block: bt.Block, words: bt.Spans, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram for each modelled byte (the symbol lowest, the byte before it next), and where each text's begin."""
    data, rows = bt.LOWER[block.data], block.rows
    keep = ~bt.SPACE[data]
    later = np.ones(len(words.starts), bool)
    later[words.first[:-1][np.diff(words.first) > 0]] = False
    gaps = words.starts[later] - 1
    keep[gaps] = True
    data[gaps] = 0x20
    lengths = block.per_row(keep)
    at = np.zeros(rows + 1, np.int64)
    np.cumsum(lengths + depth, out=at[1:])
    stream = np.full(at[-1] + depth, END, np.uint8)
    stream[np.arange(int(lengths.sum())) + np.repeat(depth * np.arange(1, rows + 1), lengths)] = data[keep]
    keys = np.zeros(at[-1], np.uint64)
    for k in range(depth, -1, -1):
        keys |= stream[depth - k : depth - k + at[-1]].astype(np.uint64) << np.uint64(8 * k)
    # of the END bytes between two texts only the first is a symbol
    real = np.ones(at[-1], bool)
    if depth > 1:
        real[(at[1:, None] - np.arange(1, depth)).reshape(-1)] = False
    return keys[real], np.concatenate([[0], np.cumsum(lengths + 1)])


class _Tally:
    """Keys with counts, merged now and then so that memory follows the distinct keys."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > _MERGE_AT and len(self.keys) > 8:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.zeros(0, np.uint64), *self.keys])
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts])
        self.keys, self.counts = [], []
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        del order
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[begins], np.add.reduceat(counts, begins) if len(keys) else counts
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return keys, counts


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.diff(np.append(begins, len(keys)))


def count_keys(docs: DataFrame, depth: int) -> DataFrame:
    """kind, key, n: how often words and grams occur in training texts; grams of other texts only are there with 0.

    docs: held_out, __text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_tally, gram_tally = _Tally(), _Tally()
        for batch in batches:
            trains = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for block in bt.blocks(batch.column("__text"), BLOCK_BYTES):
                train = trains[block.lo : block.hi]
                words = bt.words(block, lower=True)
                word_tally.add(*_counted(words.hashes[np.repeat(train, np.diff(words.first))]))
                word_tally.add(np.array([END_KEY]), np.array([train.sum()]))
                keys, first = grams(block, words, depth)
                used = np.repeat(train, np.diff(first))
                gram_tally.add(*_counted(keys[used]))
                other = np.unique(keys[~used])
                gram_tally.add(other, np.zeros(len(other), np.int64))
        for kind, tally in ((WORD, word_tally), (GRAM, gram_tally)):
            keys, counts = tally.merge()
            for lo in range(0, len(keys), 1 << 18):
                part = slice(lo, lo + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part].view(np.int64)), pa.array(counts[part])], ["kind", "key", "n"])
            tally.__init__()
        del keys, counts
        bt.release()

    # a task counts before anything is shuffled, which pays only if it has some text; coalescing small splits moves no rows
    held = docs.select("held_out", "__text")
    size = int(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    made = held.coalesce(int(min(tasks, 1 << 20))).mapInArrow(run, "kind tinyint, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: Column) -> Column:
    """Of x >= 1/2: Stirling's series after eight steps up."""
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(steps)


def gram_probabilities(counts: DataFrame, depth: int) -> DataFrame:
    """key, n, logp (log10 of the tree's probability of the symbol after its context) of each gram (key, n).

    A node is a context of 0..depth bytes and the bits decided so far of the byte after it, led by a one (1..255).
    Grams are dealt out by context once; the deepest level's nodes need no further exchange.
    """
    grams_of = counts.select("key", "n", F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("symbol")).repartition("context")
    paths = [F.struct((F.lit(1 << j) + F.shiftright("symbol", 8 - j)).cast("int").alias("decided"), F.shiftright("symbol", 7 - j).bitwiseAND(F.lit(1)).alias("bit")) for j in range(8)]
    bits = grams_of.select("context", "n", F.inline(F.array(*paths)))
    level = bits.groupBy("context", "decided").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1")).withColumn("below", F.lit(None).cast("double"))

    def measured(level: DataFrame) -> DataFrame:
        """Adds weighted (log of the weighted probability), share (of the node's own estimate in it) and one (the own estimate of a 1)."""
        own = _log_gamma(F.col("n0") + F.lit(0.5)) + _log_gamma(F.col("n1") + F.lit(0.5)) - _log_gamma((F.col("n0") + F.col("n1") + 1).cast("double")) - float(np.log(np.pi))
        level = level.withColumn("own", own).withColumn("gap", F.col("below") - F.col("own"))
        mixed = F.log(F.lit(0.5)) + F.greatest("own", "below") + F.log1p(F.exp(-F.abs("gap")))
        return level.withColumns({"weighted": F.coalesce(mixed, F.col("own")), "share": F.coalesce(1 / (1 + F.exp("gap")), F.lit(1.0)), "one": (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)})

    def parent(d: int) -> Column:
        return F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))

    levels = {}
    for d in range(depth, -1, -1):
        levels[d] = stored(level, f"tree-level-{d}")
        if d:
            level = measured(levels[d]).groupBy(parent(d).alias("context"), "decided").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
    top = measured(levels[0]).select("context", "decided", (F.col("share") * F.col("one")).alias("p"), (1 - F.col("share")).alias("rest"))
    for d in range(1, depth + 1):
        above = top.select(F.col("context").alias("parent"), "decided", F.col("p").alias("above"), "rest")
        joined = measured(levels[d]).withColumn("parent", parent(d)).join(above, ["parent", "decided"])
        top = joined.select("context", "decided", (F.col("above") + F.col("rest") * F.col("share") * F.col("one")).alias("p"), (F.col("rest") * (1 - F.col("share"))).alias("rest"))
    # at most 255 nodes a context
    chances = top.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("decided", "p"))).alias("chances"))
    told = grams_of.join(chances, "context")
    logp = F.lit(0.0)
    for j in range(8):
        one = F.try_element_at("chances", (F.lit(1 << j) + F.shiftright("symbol", 8 - j)).cast("int"))
        chance = F.when(F.shiftright("symbol", 7 - j).bitwiseAND(F.lit(1)) == 1, one).otherwise(1 - one)
        logp = logp + F.log10(F.greatest(chance, F.lit(1e-300)))
    model = stored(told.select("key", "n", logp.alias("logp")), "gram-model")
    forget(*levels.values())
    return model


def _head(table: DataFrame, most: int, value: str) -> tuple[int, bt.KeyTable]:
    """The least count of the most frequent keys, of which there are at most `most`, and their table."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in table.filter("n > 0").groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        total += n
        if total > most:
            break
        least = s
    if least is None:
        return 1 << 62, bt.KeyTable(np.zeros(0, np.uint64), np.zeros(0))
    rows = table.filter((F.col("n") > 0) & (step >= least)).select("key", F.col(value).cast("double").alias("v")).toArrow()
    return least, bt.KeyTable(rows["key"].to_numpy().view(np.uint64), rows["v"].to_numpy())


def _lists(first: np.ndarray, missing: np.ndarray, keys: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Distinct missing keys of each text and how often they occur there."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[missing]
    keys = keys[missing]
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])])) if len(row) else np.zeros(0, np.int64)
    bounds = pa.array(np.searchsorted(row[begins], np.arange(len(first))).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, pa.array(keys[begins].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(np.diff(np.append(begins, len(row))).astype(np.int32)))


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_model_bytes, bits_per_byte of each row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    counts = stored(count_keys(source, depth), "counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    totals = words.filter("n > 0").agg(F.sum("n"), F.count("*")).first()
    n_train, n_distinct = int(totals[0] or 0), int(totals[1])
    scale = float(np.log10(n_train + 0.1 * (n_distinct + 1)))
    model = gram_probabilities(counts.filter(F.col("kind") == GRAM), depth)
    head_words, head_grams = (spark.sparkContext.broadcast(_head(t, most, v)[1]) for t, most, v in ((words, HEAD_WORDS, "n"), (model, HEAD_GRAMS, "logp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, likely = head_words.value, head_grams.value
        for batch in batches:
            for block in bt.blocks(batch.column("__text"), BLOCK_BYTES):
                spans = bt.words(block, lower=True)
                # words and each text's end
                ends = spans.first[1:]
                keys = np.insert(spans.hashes, ends, END_KEY)
                first = spans.first + np.arange(block.rows + 1)
                at = frequent.find(keys)
                known = at >= 0
                logs = np.zeros(len(keys))
                logs[known] = np.log10(frequent.values[at[known]] + 0.1) - scale
                rare = _lists(first, ~known, keys)
                byte_keys, byte_first = grams(block, spans, depth)
                at = likely.find(byte_keys)
                seen = at >= 0
                likes = np.zeros(len(byte_keys))
                likes[seen] = likely.values[at[seen]]
                odd = _lists(byte_first, ~seen, byte_keys)
                kept = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("held_out"), pa.array(np.diff(first)), pa.array(bt.sums(known.astype(np.int64), first)), pa.array(bt.sums(logs, first)), pa.array(bt.sums(likes, byte_first)), pa.array(np.diff(byte_first)), *rare, *odd], ["doc_id", "held_out", "n_tokens", "known", "base", "likes", "n_model_bytes", "words", "word_counts", "grams", "gram_counts"])
        bt.release()

    kind = source.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, likes double, n_model_bytes long, words array<long>, word_counts array<int>, grams array<long>, gram_counts array<int>")
    scored = stored(made.withColumn("row", F.monotonically_increasing_id()), "scored")

    def rest(keys: str, times: str, table: DataFrame, value: Column, known: Column) -> DataFrame:
        pairs = scored.filter(F.size(keys) > 0).select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))
        return pairs.join(table, "key", "left").groupBy("row").agg(F.sum(F.col("times") * value).alias(f"{keys}_log"), F.sum(F.when(known, F.col("times")).otherwise(0)).alias(f"{keys}_known"))

    count = F.coalesce(F.col("n"), F.lit(0))
    more_words = rest("words", "word_counts", words, F.log10(count + 0.1) - scale, count > 0)
    more_grams = rest("grams", "gram_counts", model, F.col("logp"), F.lit(False)).drop("grams_known")
    found = scored.drop("words", "word_counts", "grams", "gram_counts").join(more_words, "row", "left").join(more_grams, "row", "left")
    whole = F.col("likes") + F.coalesce("grams_log", F.lit(0.0))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("words_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("words_log", F.lit(0.0))).alias("base_score"), whole.alias("score"), "n_model_bytes", (-whole / float(np.log10(2)) / F.col("n_model_bytes")).alias("bits_per_byte"),
    )
