"""Vector code compression: product quantisation with annular norm pruning.

A vector of integers is cut into equal parts, each coded by the nearest of a few codebook entries.  The entries of a part
are sorted by norm.  An entry's distance is at least the difference of the norms, so a part's
search starts at the entries nearest in norm, found by binary search, and the best distance so far allows an interval of
norms around the part's own, found by binary search again.  Every entry of that annulus, borders included, is
evaluated exactly, going outwards; each better distance narrows it.  Distances are integers, so ties are ties.

Training deals the vectors out: every task returns a count and a sum for each entry's components, which are added up by
key; only those sums (parts x entries x components) reach the driver, which divides them.

Defined results: a vector that is null or empty or has a null or non-finite component takes no part, nor does one whose
length is not that of the smallest kept id's or is no multiple of `parts`, as it cannot be cut to match;
components beyond +-2^26 after scaling are taken as those bounds, which keeps every sum exact; an id that repeats starts one entry, its smallest vector's,
and its rows are coded one by one; null ids come after all others; with fewer ids than entries the
codebooks are smaller; without vectors there are no rows; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import forget, joined_apart, stored

#: Rows that are coded at a time.
ROWS = 8192
BOUND = 1 << 26


class Annuli:
    """The entries of one part by norm, searched by annuli around a part's norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.lexsort((np.arange(len(entries)), norms))
        self.entries, self.norms = entries[self.order], norms[self.order]

    def _allowed(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last entry whose norm differs from `norm` by no more than the distance allows, rounding included."""
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-12 * (norm + reach) + 1e-6
        return np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")

    def nearest(self, x: np.ndarray, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, ties to the lower one, and its squared distance."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        best = np.full(len(x), np.iinfo(np.int64).max)
        code = np.full(len(x), len(self.entries))

        def evaluate(rows: np.ndarray, at: np.ndarray) -> None:
            off = x[rows] - self.entries[at]
            found, index = np.einsum("ij,ij->i", off, off), self.order[at]
            better = (found < best[rows]) | (found == best[rows]) & (index < code[rows])
            best[rows[better]], code[rows[better]] = found[better], index[better]
            if tally is not None:
                tally[0] += len(rows)

        everyone = np.arange(len(x))
        above = np.searchsorted(self.norms, norm)
        start = np.clip(np.where((above > 0) & (norm - self.norms[above - 1] <= self.norms[np.minimum(above, len(self.norms) - 1)] - norm), above - 1, above), 0, len(self.norms) - 1)
        evaluate(everyone, start)
        lo, hi = self._allowed(norm, best)
        down, up = start - 1, start + 1
        while True:
            below, over = np.flatnonzero(down >= lo), np.flatnonzero(up < hi)
            if not len(below) and not len(over):
                return code, best
            evaluate(below, down[below])
            evaluate(over, up[over])
            down[below] -= 1
            up[over] += 1
            touched = np.union1d(below, over)
            lo[touched], hi[touched] = self._allowed(norm[touched], best[touched])


def _matrix(column: pa.Array) -> np.ndarray:
    """[row, component] of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _coded(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, part] codes and squared distances for codebooks [part, entry, component]."""
    parts, _, width = codebooks.shape
    found = [Annuli(codebooks[p]).nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p in range(parts)]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def scaled(vectors: DataFrame, parts: int = 8, scale: float = 4096.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, label (as text) and x, the components as floor(scale * component), of the vectors that can be coded; stored."""
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = vectors.filter(F.col(vector_col).isNotNull() & finite & (F.size(vector_col) > 0))
    whole = lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(float(-BOUND))), F.lit(float(BOUND)))).cast("long")
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    numbers = usable.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(vector_col, whole).alias("x"))
    first = numbers.orderBy(F.asc_nulls_last("vec_id"), "x").select(F.size("x")).head()
    length = first[0] if first and first[0] % parts == 0 else 0
    return stored(numbers.filter(F.size("x") == length), "integer-vectors")


def _firsts(held: DataFrame, n: int) -> dict[int | None, list[int]]:
    """The n smallest ids, ascending, and the smallest vector of each; repeated ids take another pass over what follows them."""
    found: dict[int | None, list[int]] = {}
    left = held
    while len(found) < n and None not in found:
        rows = left.orderBy(F.asc_nulls_last("vec_id"), "x").select("vec_id", "x").limit(n).collect()
        for name, x in rows:
            if name not in found and len(found) < n:
                found[name] = x
        if len(rows) < n:
            break
        left = held.filter(F.col("vec_id").isNull() | (F.col("vec_id") > rows[-1][0]))
    return found


def train(held: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks [part, entry, component] of stored integer vectors, by rounds of assigning and averaging."""
    start = np.array(list(_firsts(held, entries).values()), np.int64)
    if not len(start):
        return np.zeros((parts, 0, 0), np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _averaged(held, books)
    return books


def _averaged(held: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"))
            for lo in range(0, len(x), ROWS):
                rows = x[lo : lo + ROWS]
                codes = _coded(rows, books)[0]
                for p in range(parts):
                    own, order = codes[:, p], np.argsort(codes[:, p], kind="stable")
                    first = np.flatnonzero(np.diff(own[order], prepend=-1))
                    at = own[order][first] + p * entries
                    total[at] += np.add.reduceat(rows[order, p * width : (p + 1) * width], first, axis=0)
                    n[at] += np.diff(np.append(first, len(order)))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["entry", "n", "total"])

    tasks = held.select("x").mapInArrow(run, "entry long, n long, total array<long>")
    added = tasks.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total"))
    books = books.copy()
    for entry, n, total in added.collect():  # a row per part and entry
        books[entry // entries, entry % entries] = np.array([t // n for t in total])
    return books


def encode(held: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error (squared distances summed over the parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            for lo in range(0, len(x), ROWS):
                codes, off = _coded(x[lo : lo + ROWS], books)
                names = [bytes(c).hex() for c in codes.astype(np.uint8)]
                part = batch.slice(lo, len(codes))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(names, pa.string()), pa.array(off.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return held.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: np.ndarray) -> str:
    """sha256 of all components, comma-joined by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError(f"{entries} entries do not fit into two hex digits")
    held = scaled(vectors, parts, scale, id_col, vector_col, label_col)
    books = train(held, parts, entries, rounds)
    coded = stored(encode(held, books).select("vec_id", F.col("label").isNull().alias("bare"), F.coalesce("label", F.lit("")).alias("label"), "code", "error"), "codes")
    forget(held)
    errors = coded.groupBy("bare", "label").agg(F.sum("error").alias("label_error"))
    return joined_apart(coded, errors, "bare", "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
