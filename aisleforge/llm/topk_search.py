"""Exact top-k by columnar branch-and-bound.

Vectors become integers, floor(scale * x), and lie in blocks dimension by dimension.  Vectors that point the same way
share blocks: each goes to the nearest of a bounded sample of pivots.  First every block of queries meets
one block of candidates of its own pivot, which gives each query a k-th best score that no result may stay below.  Then
all blocks of queries meet all blocks of candidates.  For some like queries at a time the candidates gather their inner products
STEP dimensions at a time, those of most energy first; after each step a candidate whose score so far plus the
product of the remaining norms (the most the rest can add) stays below every one of these queries' k-th best is
dropped, and the arrays are compacted.  What is left at the end has its whole score.  So every pair is either
scored exactly or shown to be outside its query's best k.

The queries are a stated set: their blocks are dealt to groups of candidates, as many as the candidates' blocks need.
Nothing is collected but the pivots; each pair of blocks returns at most k rows a query, which a window ranks.

Defined results: a vector that is null or has a null or non-finite component takes no part;
vectors are compared with those of their own length; equal scores go to the smaller vec_id; rows
with the query's id are its own and no candidates; repeated rows count one by one; scores beyond
64 bits are clipped to them; without vectors there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import forget, stored

BLOCK, QUERY_BLOCK, LIKE, STEP = 4096, 1024, 32, 8
#: Pivots, and vectors from which a further one is worth it.
PIVOTS, PER_PIVOT = 256, 2 * BLOCK
#: Blocks of candidates that one copy of the queries serves.
GROUP = 8


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components one after the other, and where each vector's begin."""
    lists = column.cast(pa.large_list(pa.float64()))
    return np.asarray(lists.flatten(), np.float64), np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])


def _celled(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dims and cell, the pivot (a row of length 1) that the vector points along most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, first = _lists(batch.column("x"))
            lengths = np.diff(first)
            cell = np.zeros(len(lengths), np.int32)
            for dims, held in pivots.items():
                at = np.flatnonzero(lengths == dims)
                if len(at):
                    cell[at] = (flat[(first[at][:, None] + np.arange(dims)).reshape(-1)].reshape(len(at), dims) @ held.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(cell)], [*batch.schema.names, "dims", "cell"])

    return vectors.mapInArrow(run, "vec_id long, x array<double>, q boolean, dims int, cell int")


def _blocks(vectors: DataFrame, rows: int, scale: float, n: int) -> DataFrame:
    """dims, cell, n, ids, data: blocks of at most `rows` vectors of one cell, float64 integers dimension by dimension.

    n: about how many vectors there are; a task takes some blocks' worth, however finely they were dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def cut(key: tuple[int, int], all_rows: bool) -> Iterator[pa.RecordBatch]:
            parts = held.pop(key)
            ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            while len(ids) >= rows or all_rows and len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([len(ids[:rows])], pa.int32()), pa.array([ids[:rows].astype("<i8").tobytes()], pa.binary()), pa.array([np.ascontiguousarray(data[:rows].T).astype("<f8").tobytes()], pa.binary())], ["dims", "cell", "n", "ids", "data"])
                ids, data = ids[rows:], data[rows:]
            if len(ids):
                held[key] = [(ids, data)]

        for batch in batches:
            flat, first = _lists(batch.column("x"))
            ids, dims, cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "dims", "cell"))
            keys = dims.astype(np.int64) << 32 | cells
            for key in np.unique(keys).tolist():
                at, n = np.flatnonzero(keys == key), key >> 32
                x = np.floor(scale * flat[(first[at][:, None] + np.arange(n)).reshape(-1)].reshape(len(at), n))
                held.setdefault((n, key & 0xFFFFFFFF), []).append((ids[at], x))
            # rows come cell by cell, so only the last cell can go on
            last = (int(keys[-1]) >> 32, int(keys[-1]) & 0xFFFFFFFF) if len(keys) else None
            for key in list(held):
                yield from cut(key, key != last)
        for key in list(held):
            yield from cut(key, True)

    # ranges split a cell, or an id, that many rows have
    order = ("dims", "cell", F.xxhash64("vec_id"), F.spark_partition_id())
    return vectors.repartitionByRange(*order).sortWithinPartitions("dims", "cell", "vec_id").coalesce(max(4, n // (4 * rows))).mapInArrow(run, "dims int, cell int, n int, ids binary, data binary").withColumn("number", F.monotonically_increasing_id())


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles: [query, dim] by [dim, candidate]."""
    if not a.size or not b.size:
        return np.zeros((len(a), b.shape[1]))
    most = a.shape[1] * np.abs(a).max() * np.abs(b).max()
    if most < 2**53:
        return a @ b
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64)
    wide = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object)
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, least: np.ndarray | None = None, least_ids: np.ndarray | None = None, tally: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """query number, vec_id, score of each query's best k of a block; data: [dim, candidate].

    least, least_ids: the score and id of each query's k-th best of some candidates; what comes after it is in no result.
    tally gathers how many (query, candidate) pairs were scored in full, and how many there are.
    """
    dims, n = data.shape
    floor = np.full(len(queries), -np.inf) if least is None else least.astype(float)
    if np.abs(data).max(initial=0) * np.abs(queries).max(initial=0) * max(dims, 1) >= 2**53:
        order, exact = np.arange(dims), True  # sums of doubles would not be exact
    else:
        order, exact = np.argsort(-((data**2).sum(axis=1)), kind="stable"), False
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    held, asked = data[order], queries[:, order]
    norms = (held**2).sum(axis=0)
    for lo in range(0, len(queries), LIKE):
        part, names, kth = asked[lo : lo + LIKE], query_ids[lo : lo + LIKE], floor[lo : lo + LIKE].copy()
        alive = np.arange(n)
        if exact:
            scores = _product(part, held)
        else:
            rest, mass, own_mass = held, norms, (part**2).sum(axis=1)
            scores = np.zeros((len(part), n))
            for at in range(0, dims, STEP):
                block = rest[at : at + STEP]
                scores = scores + part[:, at : at + STEP] @ block
                mass = np.maximum(mass - (block**2).sum(axis=0), 0)
                own_mass = np.maximum(own_mass - (part[:, at : at + STEP] ** 2).sum(axis=1), 0)
                # all numbers are integers under 2**53, so only the roots round
                bound = scores + np.sqrt(own_mass)[:, None] * np.sqrt(mass)[None, :] * (1 + 1e-12) + 1e-3
                stays = (bound >= kth[:, None]).any(axis=0)
                if np.count_nonzero(stays) < 0.9 * len(stays):
                    scores, rest, mass, alive = scores[:, stays], rest[:, stays], mass[stays], alive[stays]
        if tally is not None:
            tally[0] += scores.size
            tally[1] += len(part) * n
        valid = names[:, None] != ids[alive][None, :]
        if len(alive) > k + 1:
            ranked = np.where(valid, scores.astype(np.float64), -np.inf)
            kth = np.maximum(kth, np.partition(ranked, len(alive) - k, axis=1)[:, len(alive) - k])
        good = valid & (scores >= kth[:, None])
        if least_ids is not None:
            good &= (scores > floor[lo : lo + LIKE, None]) | (ids[alive][None, :] <= least_ids[lo : lo + LIKE, None])
        q, c = np.nonzero(good)
        if not len(q):
            continue
        score = scores[q, c] if scores.dtype == np.int64 else scores[q, c].astype(np.int64)
        names_of = ids[alive][c]
        # ~score turns the order around without overflow
        by = np.lexsort((names_of, ~score, q))
        q, score, names_of = q[by], score[by], names_of[by]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[top] + lo, names_of[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """At most PIVOTS vectors of length 1, by their dimensions: those with the smallest hash of vec_id."""
    if n < 2 * PER_PIVOT:
        return {}
    held: dict[int, list] = {}
    for row in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(min(PIVOTS, n // PER_PIVOT)).collect():
        held.setdefault(len(row[0]), []).append(row[0])
    return {dims: (x := np.array(rows, float)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for dims, rows in held.items() if dims}


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds its k best other rows."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, n_asked = usable.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    celled = _celled(usable, _pivots(usable, n))
    candidates = stored(_blocks(celled, BLOCK, scale, n), "candidate-blocks")
    asked = stored(_blocks(celled.filter("q"), QUERY_BLOCK, scale, n_asked).select("dims", "cell", F.col("number").alias("asked"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("data").alias("qdata")), "query-blocks")

    def unpacked(row: tuple) -> tuple[np.ndarray, ...]:
        dims, n, ids, data, qn, qids, qdata = (x.as_py() for x in row)
        return np.frombuffer(qids, "<i8"), np.ascontiguousarray(np.frombuffer(qdata, "<f8").reshape(dims, qn).T), np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(dims, n)

    columns = ("dims", "n", "ids", "data", "qn", "qids", "qdata")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_by, *row in zip(batch.column("asked"), *(batch.column(c) for c in columns), strict=True):
                names, queries, ids, data = unpacked(row)
                q, found, score = best_of_block(names, queries, ids, data, k)
                least, least_ids = np.full(len(names), -np.inf), np.full(len(names), 2**63 - 1)
                full = np.bincount(q, minlength=len(names)) == k
                last = np.flatnonzero(np.append(np.diff(q) != 0, True)) if len(q) else q
                exact = np.abs(score[last].astype(float)) < 2**53
                least[q[last[exact]]], least_ids[q[last[exact]]] = score[last[exact]], found[last[exact]]
                least = np.where(full, least, -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array([asked_by.as_py()]), pa.array([least.astype("<f8").tobytes()], pa.binary()), pa.array([least_ids.astype("<i8").tobytes()], pa.binary())], ["asked", "least", "least_ids"])

    # one block of candidates for each cell, in some copies as most queries may lie in one cell
    salts = max(1, min(64, asked.count() // 16))
    near = candidates.join(candidates.groupBy("dims", "cell").agg(F.min("number").alias("number")), ["dims", "cell", "number"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = asked.select("asked", "dims", "cell", "qn", "qids", "qdata").withColumn("salt", F.pmod(F.xxhash64("asked"), F.lit(salts))).join(near, ["dims", "cell", "salt"]).select("asked", *columns)
    bounded = asked.join(met.mapInArrow(first_pass, "asked long, least binary, least_ids binary"), "asked")
    groups = groups or max(1, -(-candidates.count() // GROUP))
    dealt = candidates.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
    copies = stored(bounded, "bounded-queries").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for least, least_ids, *row in zip(batch.column("least"), batch.column("least_ids"), *(batch.column(c) for c in columns), strict=True):
                names, queries, ids, data = unpacked(row)
                q, found, score = best_of_block(names, queries, ids, data, k, np.frombuffer(least.as_py(), "<f8"), np.frombuffer(least_ids.as_py(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    every = dealt.join(copies.drop("cell", "asked"), ["group", "dims"]).select("least", "least_ids", *columns).mapInArrow(run, "query_id long, vec_id long, score long")
    forget(asked)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
