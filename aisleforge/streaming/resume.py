"""Checkpoint and resume: every item is processed once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_new(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], form: str = "parquet", per_batch: int | None = None) -> int:
    """Processes what arrived in `source` since the last call and stops. Returns how many batches ran.

    The source's log remembers the files; each batch goes to a folder of its own number, so a batch that is run
    again after a failure replaces itself.
    """
    reader = spark.readStream.schema(schema).format(form)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    done = []

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.append(number)

    query = reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def remaining(items: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Items without a processed row."""
    return items.join(processed.select(key).distinct(), key, "left_anti")


def backups_to_drop(backups: DataFrame, keep: int = 5) -> DataFrame:
    """All but the newest (path, made_at)."""
    newest = backups.orderBy(F.desc("made_at"), F.desc("path")).limit(keep)
    return backups.join(newest, ["path"], "left_anti")


def progress(timings: DataFrame, order: str, seconds: str, total: int, group: list[str]) -> DataFrame:
    """Running mean, remaining time, and the trend of the last five against all so far (10 % either way)."""
    so_far = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(*group).orderBy(order).rowsBetween(-4, 0)
    value = F.col(seconds).cast("decimal(18,4)")
    counted = timings.withColumn("done", F.count("*").over(so_far)).withColumn("mean_all", F.round(F.sum(value).over(so_far).cast("double") / F.count("*").over(so_far), 6)).withColumn("mean_last5", F.round(F.sum(value).over(last).cast("double") / F.count("*").over(last), 6))
    trend = F.when(F.col("mean_last5") > F.col("mean_all") * 1.1, "slower").when(F.col("mean_last5") < F.col("mean_all") * 0.9, "faster").otherwise("stable")
    return counted.withColumn("eta_s", F.round(F.col("mean_all") * F.greatest(F.lit(total) - F.col("done"), F.lit(0)), 4)).withColumn("trend", trend)


def event_windows(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; on a stream, late rows are waited for as long as `late`."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
