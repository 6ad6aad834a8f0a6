"""Perception as pluggable sources: a provider turns rows into answers inside mapInPandas, with retries."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Must be picklable; it is made usable on an executor by `open`."""

    schema: str

    def open(self) -> None: ...

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class FixedProvider:
    """Answers from a function; for tests and for replaying recorded answers."""

    def __init__(self, schema: str, function) -> None:
        self.schema, self.function = schema, function

    def open(self) -> None:
        pass

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
        return self.function(batch)


def ask(df: DataFrame, provider: Provider, batch_size: int = 20, retries: int = 1, wait_s: float = 1.0, parallel: int | None = None) -> DataFrame:
    """The provider's rows for df. A batch that still fails after the retries gives one row with `error` and nulls.

    `parallel` bounds how many requests run at once by the number of partitions. Nothing is made up on failure.
    """
    schema = f"{provider.schema}, error string"
    names = [c.strip().split(" ")[0] for c in _top_level(provider.schema)]
    if parallel:
        df = df.repartition(parallel)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        for frame in frames:
            for lo in range(0, len(frame), batch_size):
                batch = frame.iloc[lo : lo + batch_size].reset_index(drop=True)
                for attempt in range(retries + 1):
                    try:
                        yield provider.answer(batch).assign(error=None)[[*names, "error"]]
                        break
                    except Exception as failure:  # any failure of a remote service is an answer of its own
                        if attempt == retries:
                            yield pd.DataFrame([{**dict.fromkeys(names), "error": f"{type(failure).__name__}: {failure}"}])
                        else:
                            time.sleep(wait_s * 2**attempt)

    return df.mapInPandas(run, schema)


def _top_level(ddl: str) -> list[str]:
    parts, depth, held = [], 0, ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(held)
            held = ""
        else:
            held += c
    return [*parts, held]


def ocr_confidence(words: F.Column) -> F.Column:
    """0.8 if any word was read."""
    return F.when(F.size(words) > 0, 0.8).otherwise(0.0)


def logos(answers: DataFrame, least: float = 0.75) -> DataFrame:
    """Logo candidates at or above a score."""
    return answers.withColumn("logo_candidates", F.filter("logo_candidates", lambda x: x["score"] >= least))


def labelled_regions(answers: DataFrame) -> DataFrame:
    """One row per annotation with its bounding box from the corners."""
    from ..functions.scores import box_bounds

    return answers.select("image_id", F.explode("texts").alias("t")).select("image_id", F.col("t.name").alias("text"), box_bounds(F.col("t.boundingPoly.vertices")).alias("box"))
