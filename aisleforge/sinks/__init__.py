"""Writers: workbooks as folders of tables, safe replacement, JSON, Markdown."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def workbook(sheets: dict[str, DataFrame], folder: str, form: str = "parquet", skip_empty: tuple[str, ...] = ()) -> dict[str, str]:
    """Writes each sheet as a table under the folder; the named sheets only if they have rows."""
    made = {}
    for name, df in sheets.items():
        if name in skip_empty and df.isEmpty():
            continue
        made[name] = f"{folder}/{name.lower().replace(' ', '_')}"
        df.write.mode("overwrite").format(form).option("header", True).save(made[name])
    return made


def excel(sheets: dict[str, DataFrame], path: str, skip_empty: tuple[str, ...] = (), split: bool = False) -> None:
    """One Excel file with a sheet for each table, with `split` as many as its rows need; the named sheets only if they have rows."""
    from ..sources.workbooks import write_workbook

    write_workbook({name: df for name, df in sheets.items() if name not in skip_empty or not df.isEmpty()}, path, split)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replaces the plain folder that df itself reads: writes beside it, then swaps the folders by renaming.

    Between the two renames there is no table; `snapshots.replace` has no such moment and sees other writers.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(form).option("header", True).save(fresh)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    existed = files.exists(place(path))
    if existed and not files.rename(place(path), place(old)):
        raise OSError(f"cannot move {path} away")
    if not files.rename(place(fresh), place(path)):
        if existed:
            files.rename(place(old), place(path))
        raise OSError(f"cannot move the new table to {path}")
    if existed:
        files.delete(place(old), True)


def duplicate_report(items: DataFrame, brand: Column, count: Column) -> DataFrame:
    """One row of JSON: how many canonical items there are, a histogram of their counts and the brands with most."""
    counted = items.select(brand.alias("brand"), count.alias("n"))
    histogram = counted.groupBy("n").agg(F.count("*").alias("items")).agg(F.array_sort(F.collect_list(F.struct("n", "items"))).alias("histogram"))
    top = counted.groupBy("brand").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "brand").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "brand"))).alias("top"))
    total = counted.agg(F.count("*").alias("canonical"), F.sum("n").alias("detections"))
    return total.crossJoin(histogram).crossJoin(top).select(F.to_json(F.struct("canonical", "detections", "histogram", F.transform("top", lambda t: F.struct(t["brand"].alias("brand"), (-t["minus_n"]).alias("n"))).alias("top_brands"))).alias("report"))  # each side is one row


def markdown(title: str, kpis: DataFrame, template: Callable[[dict], list[str]] | None = None, most: int = 1000) -> str:
    """A report from a table of few rows: a heading and one bullet per value, or what the template makes of each row.

    It is one text made on the driver, so a table of more than `most` rows is an error: nothing is left out.
    """
    lines = [f"# {title}", ""]
    rows = kpis.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write a table instead")
    for row in rows:
        held = row.asDict(recursive=True)
        lines += template(held) if template else [f"- **{k}**: {v}" for k, v in held.items()]
        lines.append("")
    return "\n".join(lines)


def copy_files(files: DataFrame, folder: str, name: Column) -> DataFrame:
    """Rows (path, content) written one file each under sanitised names, from the executors, to a local or mounted folder."""
    from ..functions.text import file_name

    def write(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            with open(os.path.join(folder, row["name"]), "wb") as out:
                out.write(row["content"])

    named = files.select(file_name(name).alias("name"), "content")
    named.foreachPartition(write)
    return named.select("name")
