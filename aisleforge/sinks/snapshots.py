"""Tables replaced as a whole without a moment in which they are missing or half written.

A table is a folder of immutable data folders and numbered manifests.  A writer puts its rows into a data folder of its own and
then makes the next manifest: written beside it and renamed to its number, which fails if the number is taken.  So a
writer that dies leaves the table as it was, a reader always sees one whole version, and of two
writers that began at the same version one gets a Conflict.  The rename is atomic where the file system's is (as on HDFS).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer made the version first."""


def _hadoop(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, table: str) -> list[int]:
    """The versions that readers can see, in order."""
    files, place = _hadoop(spark, f"{table}/{MANIFESTS}")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def latest(spark: SparkSession, table: str) -> int:
    """The newest version, 0 if there is none."""
    return max(versions(spark, table), default=0)


def _manifest(spark: SparkSession, table: str, version: int) -> dict:
    held = spark.read.text(f"{table}/{MANIFESTS}/{version:012d}.json", wholetext=True).first()
    return json.loads(held[0])


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """A version of the table, by default the newest."""
    number = latest(spark, table) if version is None else version
    if number not in versions(spark, table):
        raise FileNotFoundError(f"{table} has no version {number or 'at all'}")
    held = _manifest(spark, table, number)
    return spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(f"{table}/{held['data']}")


def _publish(spark: SparkSession, table: str, version: int, content: str) -> None:
    jvm = spark.sparkContext._jvm
    files, beside = _hadoop(spark, f"{table}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = files.create(beside, False)
    out.write(content.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    final = _hadoop(spark, f"{table}/{MANIFESTS}/{version:012d}.json")[1]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(beside, final, options)
    except Py4JJavaError as failed:
        files.delete(beside, False)
        if files.exists(final):
            raise Conflict(f"version {version} of {table} was made by another writer") from failed
        raise


def replace(df: DataFrame, table: str, based_on: int | None = None) -> int:
    """Makes df, which may read the table, its next version and returns the number.

    based_on: the version that df was computed from, by default the newest when the call begins; if another one follows it first,
    the rows are dropped and Conflict is raised.
    """
    spark = df.sparkSession
    version = (latest(spark, table) if based_on is None else based_on) + 1
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{data}")
    try:
        _publish(spark, table, version, json.dumps({"version": version, "data": data, "schema": json.loads(df.schema.json())}))
    except BaseException:
        files, place = _hadoop(spark, f"{table}/{data}")
        files.delete(place, True)
        raise
    return version


def clean(spark: SparkSession, table: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest versions and returns their numbers: the manifest first, so that no reader finds one without its rows.

    Data folders that no manifest names may be those of a writer still at work, so they are left.
    """
    gone = versions(spark, table)[: -max(keep, 1)]
    for version in gone:
        data = _manifest(spark, table, version)["data"]
        for path in (f"{table}/{MANIFESTS}/{version:012d}.json", f"{table}/{data}"):
            files, place = _hadoop(spark, path)
            files.delete(place, True)
    return gone
