"""Quality rules by weak supervision.

Every rule looks at a few counts of a text and votes good (1), bad (0) or
abstains (-1).  No rule decides alone: expectation-maximisation over the votes
of the whole corpus estimates how often texts are good and how each rule votes
on good and on bad ones, and the posterior probability of "good" given all votes
replaces the usual conjunction of filters.

EM needs only how often each combination of votes occurs.  The number of
combinations is bounded by 3 ** len(RULES) whatever the corpus holds, so that
table (not the corpus) is what reaches the driver.

Defined results: a null text counts as an empty one; a text without words has
zero counts and fails the base rule; repeated rows are judged row by row; an
empty table gives an empty result; other columns are passed over, and kept ones named
like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from ..operators.scratch import extended, stored
from .kept import with_text

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_ALPHA = np.zeros(256, bool)
_IS_ALPHA[65:91] = _IS_ALPHA[97:123] = _IS_ALPHA[128:] = True
_IS_LOUD = np.zeros(256, bool)
_IS_LOUD[[0x21, 0x3F]] = True  # ! ?

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha", "n_bytes", "n_loud", "n_bare")

#: Columns that `judge` makes.
OWN = (*COUNTS, "votes", "logs", "quality", "base_failed", "kept")

#: name: (family, ratio, whether a high ratio is bad, vote good up to (from), vote bad from (up to)); between them a rule abstains.
RULES = {
    "length": ("length", lambda c: c("n_words"), False, 100, 50),
    "word_length_low": ("length", lambda c: F.try_divide(c("word_chars"), c("n_words")), False, 3.5, 2.5),
    "word_length_high": ("length", lambda c: F.try_divide(c("word_chars"), c("n_words")), True, 9.0, 12.0),
    "symbols": ("symbols", lambda c: F.try_divide(c("n_symbols"), c("n_words")), True, 0.05, 0.2),
    "bare_words": ("symbols", lambda c: F.try_divide(c("n_bare"), c("n_words")), True, 0.1, 0.2),
    "letters": ("symbols", lambda c: F.try_divide(c("n_alpha"), c("n_bytes")), False, 0.85, 0.75),
    "dup_lines": ("repetition", lambda c: F.try_divide(c("n_dup_lines"), c("n_lines")), True, 0.1, 0.5),
    "repeats": ("repetition", lambda c: F.try_divide(c("n_repeat_words"), c("n_words")), True, 0.2, 0.5),
    "capitals": ("shouting", lambda c: F.try_divide(c("n_upper"), c("n_alpha")), True, 0.15, 0.4),
    "loudness": ("shouting", lambda c: F.try_divide(c("n_loud"), c("n_words")), True, 0.05, 0.3),
}
#: The latent classes: good texts, and one kind of bad ones for each family of rules.
CLASSES = ("good", *dict.fromkeys(r[0] for r in RULES.values()))


def block_counts(block: bt.Block) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    words = bt.words(block, lower=False)
    lines = bt.lines(block)
    data = block.data
    inside = ~bt.SPACE[data]
    n_words = np.diff(words.first)
    salt = bt.mix(np.arange(block.rows, dtype=np.uint64) + np.uint64(1))

    # lines with a word, equal to an earlier one of the same text
    row = lines.row_of()
    filled = np.flatnonzero(np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts))
    keys = bt.mix(lines.hashes[filled] ^ salt[row[filled]])
    _, seen_first = np.unique(keys, return_index=True)
    n_lines = np.bincount(row[filled], minlength=block.rows)
    n_dup = n_lines - np.bincount(row[filled][seen_first], minlength=block.rows)

    # words in windows of three that occur again in the same text
    grams, first = bt.windows(words, 3)
    made = np.diff(first)
    grams = bt.mix(grams ^ np.repeat(salt, made))
    ordered = np.sort(grams)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    marked = np.zeros(len(words.starts) + 1, bool)
    if len(again):
        near = np.minimum(np.searchsorted(again, grams), len(again) - 1)
        at = np.flatnonzero(again[near] == grams)
        at = at + np.repeat(words.first[:-1] - first[:-1], made)[at]
        for k in range(3):
            marked[at + k] = True
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_IS_ALPHA[data], out=letters[1:])
    bare = (letters[words.ends] == letters[words.starts]).astype(np.int64)
    return {
        "n_bare": bt.sums(bare, words.first),
        "n_words": n_words, "word_chars": block.per_row(inside & bt.LEADING[data]), "n_symbols": block.per_row(_IS_SYMBOL[data]),
        "n_dup_lines": n_dup, "n_repeat_words": bt.sums(marked[:-1].astype(np.int64), words.first), "n_lines": n_lines,
        "n_upper": block.per_row(_IS_UPPER[data]), "n_alpha": block.per_row(_IS_ALPHA[data] & inside), "n_bytes": block.per_row(inside), "n_loud": block.per_row(_IS_LOUD[data]),
    }


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and COUNTS of each row's text."""
    source, keep, name = with_text(docs, text_col, keep, OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bt.blocks(batch.column(name)):
                found = block_counts(block)
                kept = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], [*keep, *COUNTS])

    return source.mapInArrow(run, extended(source, keep, ", ".join(f"{c} long" for c in COUNTS)))


def votes(counts: DataFrame) -> DataFrame:
    """Adds `votes`, an array with one of 1, 0, -1 per rule."""

    def vote(rule: tuple) -> F.Column:
        _, ratio, high_is_bad, good, bad = rule
        value = ratio(lambda c: F.col(c).cast("double"))
        is_good, is_bad = (value <= good, value >= bad) if high_is_bad else (value >= good, value < bad)
        return F.when(is_bad, 0).when(is_good, 1).otherwise(-1)

    return counts.withColumn("votes", F.array(*[vote(r) for r in RULES.values()]))


def fit(patterns: list[tuple[list[int], int]], rounds: int = 200, prior: float = 0.8, pseudo: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """EM over (votes, how many texts): the share of each of CLASSES, and P(vote | class) as [rule, class, vote].

    Votes are conditionally independent given the class; abstaining is a third outcome of a rule.  Bad texts are
    bad in different ways, so each family of rules has a class of its own: in it the family's rules start with 0.8 for
    the vote bad, elsewhere with 0.05.  `pseudo` texts per class with these rates smooth the estimates.
    """
    start = np.empty((len(RULES), len(CLASSES), 3))
    start[:] = (0.05, 0.85, 0.1)
    for r, (family, *_) in enumerate(RULES.values()):
        start[r, CLASSES.index(family)] = (0.8, 0.05, 0.15)
    share = np.array([prior] + [(1 - prior) / (len(CLASSES) - 1)] * (len(CLASSES) - 1))
    first, given = share, start
    if not patterns:
        return share, given
    hot = np.eye(3)[np.array([v for v, _ in patterns]) % 3]  # -1 becomes 2
    weight = np.array([n for _, n in patterns], float)
    for _ in range(rounds):
        of_class = posterior(hot, share, given) * weight[:, None]
        before = given
        given = np.einsum("pc,prv->rcv", of_class, hot) + pseudo * start
        given /= given.sum(axis=2, keepdims=True)
        share = of_class.sum(axis=0) + pseudo * first
        share /= share.sum()
        if np.abs(given - before).max() < 1e-9:
            break
    return share, given


def posterior(hot: np.ndarray, share: np.ndarray, given: np.ndarray) -> np.ndarray:
    """P(class | votes) of one-hot votes [text, rule, vote]."""
    logs = np.einsum("prv,rcv->pc", hot, np.log(given)) + np.log(share)
    logs -= logs.max(axis=1, keepdims=True)
    odds = np.exp(logs)
    return odds / odds.sum(axis=1, keepdims=True)


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The kept columns, COUNTS, base_failed, quality (posterior probability of good) and kept."""
    counted = stored(votes(text_counts(docs, text_col, keep)), "quality-votes")
    patterns = [(list(r[0]), r[1]) for r in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    patterns.sort()
    share, given = fit(patterns)
    # the model as one expression: P(good) from each class's log prior and the votes' log likelihoods
    logs = []
    for c in range(len(CLASSES)):
        log = F.lit(float(np.log(share[c])))
        for r in range(len(RULES)):
            bad, good, none = (float(x) for x in np.log(given[r, c]))
            log = log + F.when(F.col("votes")[r] == 0, bad).when(F.col("votes")[r] == 1, good).otherwise(none)
        logs.append(log)
    rest = sum((F.exp(F.col("logs")[c] - F.col("logs")[0]) for c in range(1, len(CLASSES))), F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        counted.withColumn("logs", F.array(*logs))
        .withColumn("quality", 1 / (1 + rest))
        .drop("logs")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
