"""Toxicity: a factorization machine over hashed terms.

A text's terms are its runs of letters, lower-cased, and their leading bytes; each
is hashed into one of BUCKETS buckets and is there or not.  The logit is
    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j
so two terms that are harmless alone can count together, which additive weights miss.

The machine is fitted on a bounded sample of labelled rows: at most `per_class`
rows of either label, those with the smallest hash of doc_id, each label weighted by its share of all
labelled rows, so a score of 0.5 says that toxic is as likely as not.  Linear weights start at, and are drawn
towards, a cautious log odds of their term: terms that mostly stand together would share one weight else, and one
of them alone would count for little.  Every bucket takes part that tells the labels apart, alone or in a
pair with another one; buckets that no pair could bring over the bound are ruled out from their counts, all
pairs of the others that meet in a text are counted, by the executors, in blocks.  Counts per bucket are made by the
executors too; the driver gets those of the sample (at most BUCKETS) and, per sampled row, the buckets that may
take part.  Scoring reads every whole text once and needs no shuffle.

Defined results: a null text counts as empty and gets the intercept's score; a null
doc_id is never held out; an id labelled both ways is toxic; of rows with one id the text with
the smallest hash is learned; repeated rows get equal scores; without labelled rows of both kinds, or without a
bucket that tells them apart, every text scores the share of toxic labels (0 without labels).
an empty table gives no rows; texts of any length are scored
whole.  Kept columns named like an output give way to it, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from ..operators.scratch import extended, forget, stored
from .kept import with_text

BUCKETS = 1 << 20
PREFIX_BYTES = (5, 7)
LEAST_TEXTS = 3
#: Standard errors that a term must be apart alone, and in a pair.
LEAST, PAIRS_OVER = 3.5, 6.0
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


def held_out(doc_id: F.Column, parts: int = 5) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def block_terms(block: bt.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and where each text's begin."""
    terms = bt.words(block, lower=True, gaps=_NOT_LETTER)
    data = bt.LOWER[block.data]
    row = terms.row_of().astype(np.uint64)
    rows, hashes = [row], [terms.hashes]
    for k, n in enumerate(PREFIX_BYTES):
        long = np.flatnonzero(terms.ends - terms.starts > n)
        rows.append(row[long])
        hashes.append(bt.mix(bt.hash_spans(data, terms.starts[long], terms.starts[long] + n) + np.uint64(k + 1)))
    keys = np.unique((np.concatenate(rows) << np.uint64(20)) | (np.concatenate(hashes) & np.uint64(BUCKETS - 1)))
    first = np.searchsorted(keys >> np.uint64(20), np.arange(block.rows + 1, dtype=np.uint64))
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int32), first


@dataclass
class Machine:
    """place: bucket to feature number or -1; w0, w[feature], v[feature, factor]."""

    place: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = self.place[buckets]
        known = at >= 0
        ahead = np.zeros(len(at) + 1, np.int64)
        np.cumsum(known, out=ahead[1:])
        return sigmoid(self.logits(at[known], ahead[first]))

    def logits(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        v = self.v[features].astype(np.float64)
        pairs = (bt.sums(v[:, 0], first) ** 2 if v.shape[1] else 0) * 0.0
        for f in range(v.shape[1]):
            pairs = pairs + bt.sums(v[:, f], first) ** 2 - bt.sums(v[:, f] ** 2, first)
        return self.w0 + bt.sums(self.w[features].astype(np.float64), first) + pairs / 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def contrast(a: np.ndarray, n_a: np.ndarray | int, b: np.ndarray, n_b: np.ndarray | int) -> np.ndarray:
    """How far the shares a / n_a and b / n_b are apart, in standard errors: angles, so that empty cells need no care."""
    angles = [np.arcsin(np.sqrt((x + 0.375) / (n + 0.75))) for x, n in ((a, n_a), (b, n_b))]
    return 2 * (angles[0] - angles[1]) / np.sqrt(1 / (n_a + 0.5) + 1 / (n_b + 0.5))


def log_odds(pos: np.ndarray, n_pos: int, neg: np.ndarray, n_neg: int) -> np.ndarray:
    """Log of how much likelier a term is in toxic texts than in others, less one standard error (or 0 within it)."""
    found = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return np.sign(found) * np.maximum(0, np.abs(found) - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))


@dataclass
class Sample:
    """Rows of distinct terms in order (terms first[i]:first[i + 1] of row i) with their labels; a fixed number of texts."""

    terms: np.ndarray
    first: np.ndarray
    labels: np.ndarray

    @staticmethod
    def of(texts: list[np.ndarray], labels: np.ndarray) -> Sample:
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        return Sample(flat.astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), np.asarray(labels, bool))

    def only(self, wanted: np.ndarray) -> Sample:
        """With the wanted terms (in order) alone, numbered by their place."""
        at = np.full(BUCKETS, -1, np.int32)
        at[wanted] = np.arange(len(wanted))
        found = at[self.terms]
        ahead = np.concatenate([[0], np.cumsum(found >= 0)])
        return Sample(found[found >= 0], ahead[self.first], self.labels)

    def counts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """In how many toxic and in how many other texts each term is."""
        toxic = np.repeat(self.labels, np.diff(self.first))
        return np.bincount(self.terms[toxic], minlength=size), np.bincount(self.terms[~toxic], minlength=size)


def pairable(pos: np.ndarray, neg: np.ndarray, over: float) -> np.ndarray:
    """Terms that some pair could bring over: no part of a term's texts differs more from the rest than its toxic ones do."""
    return np.flatnonzero(np.abs(contrast(pos, pos, np.zeros_like(neg), neg)) > over)


def block_pairs(sample: Sample, lo: int, hi: int, over: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms that tell the labels apart beside one of the terms lo:hi as neither does alone, and how well.

    For two terms, the share of toxic texts among those with both is held against the share among those with
    only the one and against that among those with only the other; the weaker contrast counts, so a term that is
    telling by itself does not bring in what stands beside it.  Pairs that meet in a text are counted, no others.
    """
    size = 1 + int(sample.terms.max(initial=-1))
    alone = sample.counts(size)
    width = size - lo
    both = np.zeros((2, (hi - lo) * width), np.int32)
    for row in range(len(sample.labels)):
        held = sample.terms[sample.first[row] : sample.first[row + 1]]
        held = held[np.searchsorted(held, lo) :].astype(np.int64) - lo
        mine = held[: np.searchsorted(held, hi - lo)]
        if len(mine):
            # a text's pairs are distinct, so none is counted once for two
            both[0 if sample.labels[row] else 1][(mine[:, None] * width + held[None, :]).reshape(-1)] += 1
    best = np.zeros(size, np.float64)
    for begin in range(0, hi - lo, 32):
        part = both[:, begin * width : min(begin + 32, hi - lo) * width]
        # by the formula, no pair of fewer texts can be over
        at = np.flatnonzero((part[0] + part[1] + 0.5) * np.pi**2 > over**2)
        r, c = at // width + lo + begin, at % width + lo
        p, n = part[0, at].astype(float), part[:, at].sum(axis=0).astype(float)
        z = [contrast(p, n, alone[0][x] - p, alone[0][x] + alone[1][x] - n) for x in (r, c)]
        z = np.where((z[0] > 0) == (z[1] > 0), np.minimum(np.abs(z[0]), np.abs(z[1])), 0)
        z[r >= c] = 0
        np.maximum.at(best, r, z)
        np.maximum.at(best, c, z)
    found = np.flatnonzero(best > over)
    return found, best[found]


def paired_terms(sample: Sample, over: float, spark: SparkSession | None = None, step: int = 256) -> np.ndarray:
    """Buckets that tell the labels apart in a pair as neither does alone, in order.

    Blocks of `step` terms against all are dealt to tasks, to which the sample (of a bounded number of texts) is
    broadcast; without a session they are counted here.
    """
    wanted = pairable(*sample.counts(BUCKETS), over)
    held = sample.only(wanted)
    size = 1 + int(held.terms.max(initial=-1))
    blocks = [(lo, min(lo + step, size)) for lo in range(0, size, step)]
    if spark is None or len(blocks) < 2:
        found = [block_pairs(held, lo, hi, over)[0] for lo, hi in blocks]
    else:
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(block_pairs(shared.value, lo, min(lo + step, size), over)[0])], ["term"])

        # at most one row a term and block, and a term only once here
        table = spark.range(0, size, step, len(blocks)).mapInArrow(run, "term long").distinct().toArrow()
        found = [table["term"].to_numpy()]
        shared.unpersist()
    return wanted[np.unique(np.concatenate(found))] if found else wanted[:0]


def telling(pos: np.ndarray, n_pos: int, neg: np.ndarray, n_neg: int, least: float) -> np.ndarray:
    """Buckets that tell the labels apart alone, from how many texts of either label have them."""
    return np.flatnonzero((pos + neg >= LEAST_TEXTS) & (np.abs(contrast(pos, n_pos, neg, n_neg)) > least))


def fit(texts: list[np.ndarray], labels: np.ndarray, share: float, least: float = LEAST, pairs_over: float = PAIRS_OVER, factors: int = 8, epochs: int = 100, rate: float = 0.5, l2: float = 1e-4, seed: int = 7, spark: SparkSession | None = None) -> Machine:
    """Adagrad on the logistic loss over the buckets of each text, labels weighted by their share.

    share: of toxic labels, the score where nothing can be learned.  With a session pairs are counted by its executors.
    """
    place = np.full(BUCKETS, -1, np.int32)
    labels = np.asarray(labels, bool)
    n_pos, n_neg = int(labels.sum()), int((~labels).sum())
    base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    plain = Machine(place, base, np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    if not n_pos or not n_neg:
        return plain
    sample = Sample.of(texts, labels)
    pos, neg = sample.counts(BUCKETS)
    chosen = np.union1d(telling(pos, n_pos, neg, n_neg, least), paired_terms(sample, pairs_over, spark))
    if not len(chosen):
        return plain
    place[chosen] = np.arange(len(chosen))
    n = len(chosen)
    # one spare feature pads the rows to rectangles; it never has weight
    rows = [np.sort(place[t][place[t] >= 0]) for t in texts]
    rng = np.random.default_rng(seed)
    # weights start at, and are drawn towards, what a term says by itself: terms seen only together would share one weight else
    alone = np.append(log_odds(pos[chosen], n_pos, neg[chosen], n_neg), 0.0)
    w0, w, v = base, alone.copy(), rng.normal(0, 0.01, (n + 1, factors))
    v[n] = 0
    g0, gw, gv = 1e-8, np.full(n + 1, 1e-8), np.full((n + 1, factors), 1e-8)
    y = labels.astype(float)
    weight = np.where(labels, share / n_pos, (1 - share) / n_neg) * len(labels)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 256):
            batch = order[lo : lo + 256]
            lengths = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch]) if lengths.sum() else np.zeros(0, np.int64)
            first = np.concatenate([[0], np.cumsum(lengths)])
            of = np.repeat(np.arange(len(batch)), lengths)
            vf = v[flat]
            total = np.stack([bt.sums(vf[:, f], first) for f in range(factors)], axis=1)
            squares = bt.sums((vf**2).sum(axis=1), first)
            logit = w0 + bt.sums(w[flat], first) + ((total**2).sum(axis=1) - squares) / 2
            slope = (sigmoid(logit) - y[batch]) * weight[batch] / len(batch)
            d0 = slope.sum()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            if not len(flat):
                continue
            used, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, slope[of], len(used)) + l2 * (w[used] - alone[used])
            dv = np.stack([np.bincount(back, slope[of] * (total[of, f] - vf[:, f]), len(used)) for f in range(factors)], axis=1) + l2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate / 4 * dv / np.sqrt(gv[used])
    return Machine(place, w0, w[:n].astype(np.float32), v[:n].astype(np.float32))


def _terms_of(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    source, keep, name = with_text(docs, text_col, keep, ["terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column(name)):
                buckets, first = block_terms(block)
                kept = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(buckets))], [*keep, "terms"])

    return source.mapInArrow(run, extended(source, keep, "terms array<int>"))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = 6000) -> Machine:
    """Fits a machine on at most per_class labelled rows of either label, none of them held out."""
    given = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id")))
    known = given.groupBy("__id").agg(F.max("__label").alias("__label"))
    counts = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = (F.xxhash64("__id"), F.col("__id"))
    parts = [known.filter(F.col("__label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    # at most 2 * per_class ids, so that side is small by construction
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(sample, "__id")
    made = stored(_terms_of(rows.withColumn("__key", F.xxhash64("__text")), "__text", ["__id", "__label", "__key"]), "toxicity-sample")
    chosen = made.groupBy("__id", "__label").agg(F.min_by("terms", "__key").alias("terms"))
    per_bucket = chosen.select("__label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.sum("__label").alias("pos"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_TEXTS).toArrow()
    bucket, of_pos, n = (per_bucket[c].to_numpy().astype(np.int64) for c in ("bucket", "pos", "n"))
    pos, neg = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    pos[bucket], neg[bucket] = of_pos, n - of_pos
    sizes = {r[0]: r[1] for r in chosen.groupBy("__label").count().collect()}
    wanted = np.zeros(BUCKETS, bool)
    wanted[telling(pos, sizes.get(1, 0), neg, sizes.get(0, 0), LEAST)] = True
    wanted[pairable(pos, neg, PAIRS_OVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                terms = np.asarray(batch.column("terms")[row].values)
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(row, 1), batch.column("__label").slice(row, 1), pa.array([terms[wanted[terms]]], pa.list_(pa.int32()))], ["__id", "__label", "terms"])

    table = chosen.select("__id", "__label", "terms").mapInArrow(run, chosen.select("__id", "__label", "terms").schema).toArrow()
    rows = sorted(zip(table["__id"].to_pylist(), table["__label"].to_pylist(), range(table.num_rows), strict=True))
    lists = table["terms"].combine_chunks()
    texts = [np.asarray(lists[i].values) for *_, i in rows]
    forget(made)
    machine = fit(texts, np.array([y for _, y, _ in rows]), share, spark=docs.sparkSession)
    del table, lists, texts, rows, per_bucket, bucket, of_pos, n
    bt.release()  # the driver goes on after this
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and each whole text's probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most BUCKETS places and weights
    source, keep, name = with_text(docs, text_col, keep, ["score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for block in bt.blocks(batch.column(name)):
                kept = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), pa.array(held.scores(*block_terms(block)))], [*keep, "score"])

    return source.mapInArrow(run, extended(source, keep, "score double"))
