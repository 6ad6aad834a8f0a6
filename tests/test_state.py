"""Progress as streaming state: equal to the batch windows, across batches, restarts and stalled keys."""

import os
import random
import time

from aisleforge.streaming import state
from aisleforge.streaming.resume import progress

SCHEMA = "user_id long, event_id long, value double"


def feed(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, **more):
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return state.progress_stream(read, "user_id", "event_id", "value", 8, **more)


def test_replay_and_restart_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.choice([round(rng.uniform(0, 9), 5), 0.00005, 12.5])) for k in range(60)]
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    feed(spark, rows[:20], folder, "a")
    assert state.run_to_end(stream(spark, folder), out, log) == 1
    # the query is started anew on the same checkpoint: state and what is done go on, nothing is counted twice
    feed(spark, rows[20:35], folder, "b")
    feed(spark, rows[35:], folder, "c")
    assert state.run_to_end(stream(spark, folder), out, log) >= 2
    assert state.run_to_end(stream(spark, folder), out, log) <= 1
    columns = ["user_id", "event_id", "done", "mean_all", "mean_last5", "eta_s", "trend"]
    want = progress(spark.createDataFrame(rows, SCHEMA), "event_id", "value", 8, ["user_id"]).select(columns).collect()
    got = spark.read.parquet(out).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 60


def test_an_idle_key_is_reported_and_forgotten(spark, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    feed(spark, [(1, 1, 2.0), (1, 2, 4.0)], folder, "a")
    query = stream(spark, folder, idle_s=0).writeStream.format("parquet").option("checkpointLocation", log).trigger(processingTime="0 seconds").start(out)
    try:
        found = []
        for _ in range(90):
            time.sleep(1)
            found = spark.read.schema("user_id long, event_id long, done long, mean_all double, trend string").parquet(out).collect() if os.path.isdir(f"{out}/_spark_metadata") else []
            if len(found) == 3:
                break
    finally:
        query.stop()
    assert sorted((r.done, r.mean_all, r.trend) for r in found if r.event_id is None) == [(2, 3.0, "stalled")] and len(found) == 3
