"""Assortment measures: grouped aggregates, shares, concentration, buckets.

Every function takes a DataFrame and column names and returns one declared plan: partial aggregation
before each shuffle, shares by a second aggregate over the already grouped (small) result.
Averages of fractions are taken over DECIMAL sums so that results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(c: Column | str, places: int = 6) -> Column:
    """Average over decimals, rounded."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(c.cast("decimal(18,4)")).cast("double") / F.count(c), places)


def ratio(a: Column, b: Column, factor: float = 1.0, places: int = 6) -> Column:
    """a / b * factor rounded; null when b is 0."""
    return F.round(F.try_divide(a.cast("double") * factor, b.cast("double")), places)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def known(brand: Column) -> Column:
    """Neither null nor one of the words for not knowing."""
    return brand.isNotNull() & ~F.lower(brand).isin("unknown", "unidentified", "n/a", "none", "")


def matches(c: Column, words: list[str]) -> Column:
    """Case-insensitive search for any of the words as they are; null does not match."""
    import re

    return F.coalesce(c.rlike("(?i)" + "|".join(re.escape(w) for w in words)), F.lit(False))


def portfolio(df: DataFrame, store: str = "supermarket") -> DataFrame:
    """Rows are grouped once; distinct counts, which copy their input for every column, see only distinct combinations."""
    held = df.groupBy(store, "brand", "category", "product_type", "origin").agg(F.count("*").alias("n"))
    of = lambda origin: F.coalesce(F.sum(F.when(F.col("origin") == origin, F.col("n"))), F.lit(0))
    return held.groupBy(store).agg(
        F.sum("n").alias("products"), F.countDistinct("brand").alias("brands"), F.countDistinct("category").alias("categories"), F.countDistinct("product_type").alias("types"),
        of("local").alias("local_products"), of("international").alias("international_products"),
    )


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key without null keys, and their share of those rows."""
    counted = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return with_share(counted, "n", "share")


def with_share(counted: DataFrame, value: str, name: str, within: list[str] | None = None, factor: float = 1.0, places: int = 6) -> DataFrame:
    """A grouped result with each value's share of the total, or of the total of its `within` group."""
    # a total over everything is one number, not a window that would pull all keys into one task
    total = F.sum(value).over(Window.partitionBy(*within)) if within else counted.agg(F.sum(value)).scalar()
    return counted.withColumn(name, ratio(F.col(value), total, factor, places))


def hhi(df: DataFrame, key: str, by: list[str], name: str = "hhi", known_only: bool = False, factor: float = 1.0) -> DataFrame:
    """Sum of squared shares of the keys in each group; the denominator is all rows, or with known_only the rows with a key."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    squares = F.sum(F.when(F.col(key).isNotNull(), F.col("n").cast("decimal(20,0)") * F.col("n")))
    total = F.sum(F.when(F.col(key).isNotNull(), F.col("n")) if known_only else F.col("n"))
    return counts.groupBy(*by).agg(F.round(F.try_divide(squares.cast("double"), F.pow(total.cast("double"), F.lit(2.0))) * factor, 6).alias(name))


def size_buckets(df: DataFrame, key: str, by: list[str], edges: list[tuple[str, int, int | None]]) -> DataFrame:
    """How many keys of each group have so many rows: label, from, up to (both inclusive)."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"))
    label = F.lit(None).cast("string")
    for name, low, high in reversed(edges):
        inside = F.col("n") >= low if high is None else F.col("n").between(low, high)
        label = F.when(inside, name).otherwise(label)
    return counts.groupBy(*by, label.alias("bucket")).agg(F.count("*").alias("keys"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with one column per value; giving the values saves the pass that would look for them."""
    return df.groupBy(row).agg(*[count_where(F.col(column) == v).alias(v) for v in values])


def top_n_others(df: DataFrame, key: str, n: int, rest: str = "Others") -> DataFrame:
    """The n most frequent keys and one row for all others, which is missing if there are none."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(n)
    others = counts.join(F.broadcast(top.select(key)), key, "left_anti").agg(F.sum("n").alias("n")).filter("n IS NOT NULL")  # n rows
    return top.select(key, "n").unionByName(others.select(F.lit(rest).alias(key), "n"))


def top_k(df: DataFrame, key: str, k: int, weight: Column | None = None) -> DataFrame:
    value = F.count("*") if weight is None else F.sum(weight)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(value.alias("n")).orderBy(F.desc("n"), key).limit(k)


def top_k_per_group(counted: DataFrame, group: list[str], key: str, value: str, k: int) -> DataFrame:
    """The k largest of each group of a grouped result, ties by key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), key))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows per bin of equal width between the smallest and the largest value, which belongs to the last bin."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.groupBy(F.lit(1).alias("bin")).count().filter("false")
    width = (high - low) or 1.0
    place = F.least(F.floor((F.col(value) - low) / width * bins) + 1, F.lit(bins)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The exact median of each group, from how often each value occurs: a group's rows are never held together."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(*by))})
    middle = [F.min(F.when(F.col("upto") >= F.floor((F.col("total") + k) / 2), F.col(value))) for k in (1, 2)]
    return placed.groupBy(*by).agg(((middle[0] + middle[1]) / 2).alias("median"))


def band(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first step that the value stays under."""
    found = None
    for limit, label in steps:
        found = F.when(value < limit, label) if found is None else found.when(value < limit, label)
    return found.otherwise(rest)
