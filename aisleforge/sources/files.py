"""File sources: images, CSV, JSON arrays, JSON records, workbooks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import stored

# fixed values: the suffixes that count as images
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "heic", "webp")


def images(spark: SparkSession, path: str, recursive: bool = True, limit: int | None = None, content: bool = True) -> DataFrame:
    """Image files by any case of their suffix, with image_id img0001, img0002, ... in the order of their paths.

    Without `content` only names and sizes are read. Numbering needs one order over all paths, so it happens
    on names alone; bytes are joined to it.
    """
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in IMAGE_SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    names = files.select("path", "length")
    if limit is not None:
        names = names.orderBy("path").limit(limit)
    numbered = with_sequence(names, "path", "img%04d", "image_id")
    return numbered.join(files.select("path", "content"), "path") if content else numbered


def with_sequence(df: DataFrame, order: str, pattern: str, name: str) -> DataFrame:
    """A formatted running number in the order of a column, counted per range partition and then offset.

    A window over everything would pull all rows into one task; here only one count per partition reaches the driver.
    """
    # stored once: the bounds of ranges are sampled, so counts and numbers must come from the same partitions
    ordered = stored(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "ordered")
    counts = {r[0]: r[1] for r in ordered.groupBy("__part").count().collect()}
    ahead, pairs = 0, []
    for part in sorted(counts):
        pairs += [F.lit(part), F.lit(ahead)]
        ahead += counts[part]
    if not pairs:
        return df.withColumn(name, F.lit(None).cast("string"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ordered.withColumn(name, F.format_string(pattern, inner + F.create_map(*pairs)[F.col("__part")])).drop("__part")


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_records(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """One JSON document per file: a bad one is skipped, or with `strict` fails the read."""
    if strict:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(marked).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def workbook(spark: SparkSession, path: str, joined: bool = False) -> dict[str, DataFrame]:
    """Every sheet of an Excel file as a table; with `joined` those that a table was split into are one again."""
    from .workbooks import numbered, read_workbook, sheet_names

    names, found, parts = sheet_names(path), {}, set()
    for name in names:
        if name in parts:
            continue
        own = [name]
        while joined and numbered(name, len(own) + 1) in names:
            own.append(numbered(name, len(own) + 1))
        found[name] = read_workbook(spark, path, own)
        parts.update(own)
    return found


def first_available(sources: dict[str, DataFrame], preferred: Iterable[str], column: str = "brand") -> tuple[str, DataFrame] | None:
    """The first preferred dataset there is, else any that has the column."""
    for name in preferred:
        if name in sources:
            return name, sources[name]
    return next(((n, df) for n, df in sources.items() if column in df.columns), None)


def sheets_to_csv(sheets: dict[str, DataFrame], folder: str, route: Callable[[str], str]) -> list[str]:
    """Writes each sheet as a CSV folder named by `route` of the sheet's name."""
    made = []
    for name, df in sheets.items():
        made.append(f"{folder}/{route(name)}")
        df.write.mode("overwrite").option("header", True).csv(made[-1])
    return made
