"""Snapshots of tables, embedding matrices: round trips, conflicts, dying writers, single rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleforge.sinks import matrix, snapshots


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshots_follow_each_other(spark, tmp_path):
    table = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, table)
    assert snapshots.replace(spark.createDataFrame([(1, "Drinks"), (2, "Other")], "id int, c string"), table) == 1
    held = snapshots.read(spark, table)
    # the new version is computed from the one it replaces
    assert snapshots.replace(held.withColumn("c", F.when(F.col("c") == "Other", "Snacks").otherwise(F.col("c"))), table) == 2
    assert values(snapshots.read(spark, table)) == [(1, "Drinks"), (2, "Snacks")] and values(snapshots.read(spark, table, 1)) == [(1, "Drinks"), (2, "Other")]
    assert values(held) == [(1, "Drinks"), (2, "Other")]  # a reader keeps the version it began with
    assert snapshots.replace(held.limit(0), table) == 3 and snapshots.read(spark, table).columns == ["id", "c"] and snapshots.read(spark, table).count() == 0
    assert snapshots.clean(spark, table, keep=1) == [1, 2] and snapshots.versions(spark, table) == [3]


def test_of_two_writers_one_wins(spark, tmp_path):
    table = str(tmp_path / "table")
    snapshots.replace(spark.range(3).toDF("id"), table)
    base = snapshots.latest(spark, table)
    mine, yours = (snapshots.read(spark, table).withColumn("id", F.col("id") + k) for k in (10, 20))
    assert snapshots.replace(mine, table, based_on=base) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(yours, table, based_on=base)
    assert values(snapshots.read(spark, table)) == [(10,), (11,), (12,)]
    assert len([n for n in os.listdir(table) if n.startswith("data-")]) == 2  # the loser's rows are gone
    assert not [n for n in os.listdir(f"{table}/_manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_a_writer_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    snapshots.replace(spark.range(3).toDF("id"), table)
    with monkeypatch.context() as broken:
        broken.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            snapshots.replace(spark.range(9).toDF("id"), table)
    with pytest.raises(Exception, match="no_such"):
        snapshots.replace(spark.range(9).select(F.expr("assert_true(id < 5, 'no_such') AS x")), table)
    assert snapshots.versions(spark, table) == [1] and snapshots.read(spark, table).count() == 3


def test_matrix_round_trip_and_lookup(spark, tmp_path):
    rng, folder = random.Random(2), str(tmp_path / "matrix")
    rows = [(k * 3, [rng.random() for _ in range(5)]) for k in range(300)] + [(30, [0.5] * 5), (None, [1.0] * 5), (7, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    manifest = matrix.write_matrix(df, folder, parts=7)
    want = sorted((k, [float(np.float32(x)) for x in v]) for k, v in rows if k is not None and v is not None)
    assert manifest["rows"] == 301 and manifest["dims"] == 5 and 1 < len(manifest["parts"]) <= 7
    got = matrix.read_matrix(spark, folder, rows=13).orderBy("row").collect()
    assert [r.row for r in got] == list(range(301)) and [r.id for r in got] == [k for k, _ in want]
    assert sorted((r.id, list(r.vector)) for r in got) == want
    # every part is a plain .npy file
    part = manifest["parts"][1]
    held = np.load(f"{folder}/{part['file']}.npy")
    assert held.shape == (part["rows"], 5) and np.load(f"{folder}/{part['file']}.ids.npy")[0] == part["first_id"]
    asked = spark.createDataFrame([(30,), (31,), (0,), (897,), (None,), (30,)], "id long")
    assert sorted((r.id, r.row) for r in matrix.lookup(asked, folder).collect()) == sorted((k, i) for i, (k, _) in enumerate(want) if k in (30, 0, 897))
    # with the other parts away, a row is still found: a lookup opens one part only
    for other in manifest["parts"]:
        if other is not part:
            os.rename(f"{folder}/{other['file']}.npy", f"{folder}/{other['file']}.gone")
    one = matrix.lookup(spark.createDataFrame([(part["last_id"],)], "id long"), folder).collect()
    assert one and all(list(r.vector) == dict(want)[part["last_id"]] or part["last_id"] == 30 for r in one)


def test_matrices_of_nothing_and_of_unequal_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert matrix.write_matrix(df.limit(0), str(tmp_path / "none")) == {"rows": 0, "dims": 0, "parts": []}
    assert matrix.read_matrix(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="another length|different lengths"):
        matrix.write_matrix(df, str(tmp_path / "odd"), parts=1)
