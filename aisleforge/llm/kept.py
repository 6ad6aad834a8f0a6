"""Columns that an operator carries along."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_text(docs: DataFrame, text_col: str, keep: Iterable[str], own: Iterable[str]) -> tuple[DataFrame, list[str], str]:
    """The kept columns and the text as a string; the columns kept, and the text's name, which none of them has.

    own: names of the operator's outputs; a kept column of such a name (in any case) gives way.
    """
    taken = {c.lower() for c in own}
    kept = [c for c in keep if c.lower() not in taken]
    name = "__text"
    while name in {c.lower() for c in kept}:
        name += "_"
    return docs.select(*kept, F.col(text_col).cast("string").alias(name)), kept, name
