"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the tables lie that `stored` has returned and nobody has forgotten.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Whether the files of a query's shuffles go when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys that may hold more than one in HOT of all rows are joined apart, so there are fewer than HOT of them.
HOT = 1000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and the master is this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, held = _at(spark, path)
    system.deleteOnExit(held)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage and survives lost executors.

    The table goes when it is forgotten, else when the session's JVM ends; what was shuffled for it goes at once.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that no later result reads any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            dropped(table.sparkSession, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by `fresh_folder`."""
    system, held = _at(spark, path)
    system.delete(held, True)


def extended(source: DataFrame, keep: tuple[str, ...] | list[str], more: str) -> T.StructType:
    """The schema of the kept columns and further ones given as DDL."""
    return T.StructType([*source.select(*keep).schema.fields, *T.StructType.fromDDL(more).fields])


def joined_apart(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Inner join of stored rows with a table of one row per key, where a few keys may hold most of the rows.

    Rows of such keys, fewer than HOT, meet a broadcast part of the table; the others are shuffled as usual.
    """
    most = rows.count() // HOT
    hot = F.broadcast(rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(*keys))
    frequent = F.broadcast(table.join(hot, list(keys), "left_semi"))
    return rows.join(frequent, list(keys)).unionByName(rows.join(hot, list(keys), "left_anti").join(table, list(keys)))
