"""Joins and set operations with the semantics reports expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_last(df: DataFrame, pairs: DataFrame, key: str, value: str, order: str, into: str) -> DataFrame:
    """Replaces `into` by the looked-up value of the last pair of a key; rows without a pair stay."""
    last = pairs.groupBy(key).agg(F.max_by(value, order).alias("__value"))
    return df.join(last, key, "left").withColumn(into, F.coalesce("__value", into)).drop("__value")


def aligned(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Two count tables (key, n) side by side with zeros for missing keys, and their total."""
    joined = a.select(key, F.col("n").alias(names[0])).join(b.select(key, F.col("n").alias(names[1])), key, "full_outer").fillna(0, subset=list(names))
    return joined.withColumn("total", F.col(names[0]) + F.col(names[1]))


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both sets, of what they share and of what either has alone, and the share of the smaller set. Null is a member."""
    pairs = a.select(key).distinct().withColumn("a", F.lit(1)).unionByName(b.select(key).distinct().withColumn("b", F.lit(1)), allowMissingColumns=True)
    per_key = pairs.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both, only_a, only_b = (F.count(F.when(c, 1)) for c in (F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b").isNull(), F.col("a").isNull()))
    sizes = per_key.agg(F.count("a").alias("size_a"), F.count("b").alias("size_b"), both.alias("shared"), only_a.alias("only_a"), only_b.alias("only_b"))
    return sizes.withColumn("overlap_pct", F.round(F.try_divide(F.col("shared") * F.lit(100.0), F.least("size_a", "size_b").cast("double")), 6))


def overlap_band(percent: Column) -> Column:
    """How much two assortments differ."""
    return F.when(percent < 30, "High").when(percent < 60, "Moderate").otherwise("Low")


def unmapped(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Values that are not in the allowed table."""
    return df.select(column).distinct().join(allowed.select(column), column, "left_anti").filter(F.col(column).isNotNull())


def positional(answers: DataFrame, batch: DataFrame, batch_key: str, array: str, order: str) -> DataFrame:
    """Zips the k-th answer of a batch to its k-th row; prefer answers that carry a key."""
    numbered = batch.withColumn("pos", F.row_number().over(Window.partitionBy(batch_key).orderBy(order)) - 1)
    return numbered.join(answers.select(batch_key, F.posexplode(array).alias("pos", "answer")), [batch_key, "pos"])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")
