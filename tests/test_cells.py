"""Blocks are files that tasks read two at a time; what was shuffled for a stored table goes at once."""

import numpy as np
import pyarrow as pa

from aisleforge.operators import cells as C
from aisleforge.operators import mixed, scratch


def test_a_task_holds_two_blocks(spark, monkeypatch):
    class Side:
        alive = 0

        def __init__(self, block):
            self.ids = block.column("id")
            Side.alive += 1
            assert Side.alive <= 2, "a task holds more than two blocks"

        def __del__(self):
            Side.alive -= 1

    monkeypatch.setattr(C, "TASKS", 1)
    folder = C.blocks_folder(spark, "blocks")
    names = [C.written(folder, pa.RecordBatch.from_arrays([pa.array([k * 2, k * 2 + 1])], ["id"])) for k in range(6)]
    listed = scratch.stored(spark.createDataFrame([(x, y) for x in names for y in names if x <= y], "x string, y string"), "cells")

    def met(left, right, same):
        i, j = np.indices((2, 2)).reshape(2, -1)
        yield (i[i < j], j[i < j]) if same else (i, j)

    found = C.met_in_cells(listed, "bigint", folder, Side, met, "pairs")
    assert {(min(r), max(r)) for r in map(tuple, found.collect())} == {(a, b) for a in range(12) for b in range(a + 1, 12)} and found.count() == 66


def test_blocks_are_not_shuffled(spark, monkeypatch):
    plans, kept = [], scratch.stored

    def stored(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(C, "stored", stored)
    rows = [(k, 0, [1.0, 0.5], [k % 7, 100 + k % 5]) for k in range(50)]
    found = mixed.like_both(spark.createDataFrame(rows, "id long, kind int, v array<double>, h array<long>"), 0.6, 0.4, 0.99, block=8)
    assert found.count() == sum(a[3] == b[3] for a in rows for b in rows if a < b)
    assert [name for name, _ in plans] == ["alike-both"] and all("bits" not in plan and "binary" not in plan for _, plan in plans)


def test_shuffled_files_go_with_the_write(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        found = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles())
        return {f.getName() for f in found if f.getName().startswith("shuffle_")}

    before, setting = held(), spark.conf.get(scratch.CLEANUP)
    table = scratch.stored(spark.range(1000).repartition(4, "id"), "dealt")
    assert held() <= before and spark.conf.get(scratch.CLEANUP) == setting and table.count() == 1000
