"""Sources, providers, sinks and incremental runs."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleforge import __main__ as cli
from aisleforge import sinks
from aisleforge.sources import files, providers
from aisleforge.streaming import resume


def test_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.JPG", "a.png", "sub/c.jpeg", "note.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.images(spark, str(tmp_path)).orderBy("path").collect()
    assert [(os.path.basename(r.path), r.image_id, bytes(r.content).decode()) for r in found] == [("a.png", "img0001", "a.png"), ("b.JPG", "img0002", "b.JPG"), ("c.jpeg", "img0003", "sub/c.jpeg")]
    assert files.images(spark, str(tmp_path), recursive=False, limit=1, content=False).count() == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.json_array(spark, str(tmp_path / "array.json"), "a int").count() == 2
    records = tmp_path / "records"
    records.mkdir()
    (records / "1.json").write_text('{"a": 1}')
    (records / "2.json").write_text('{"a": oops')
    schema = T.StructType().add("a", T.IntegerType())
    assert [r.a for r in files.json_records(spark, str(records), schema).collect()] == [1]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        files.json_records(spark, str(records), schema, strict=True).collect()


def test_csv_round_trip_and_replace(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"", 1), ("c\nd", 2)], "t string, n int")
    sinks.csv(df, str(tmp_path / "t"))
    back = files.csv(spark, str(tmp_path / "t"), "t string, n int")
    assert sorted(r.n for r in back.collect()) == [1, 2]
    path = str(tmp_path / "p")
    df.write.parquet(path)
    sinks.replace(spark.read.parquet(path).withColumn("n", F.col("n") + 1), path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [2, 3]
    assert [x for x in os.listdir(tmp_path) if ".old" in x or ".new" in x] == []


def test_workbook_skips_empty_sheets(spark, tmp_path):
    sheets = {"All Rows": spark.range(3).toDF("a"), "Issues": spark.range(0).toDF("a")}
    made = sinks.workbook(sheets, str(tmp_path / "w"), skip_empty=("Issues",))
    assert list(made) == ["All Rows"] and spark.read.parquet(made["All Rows"]).count() == 3
    routed = files.sheets_to_csv({"Sheet Brand": spark.range(1).toDF("a")}, str(tmp_path / "c"), lambda n: "brand" if "Brand" in n else "other")
    assert routed == [str(tmp_path / "c/brand")]


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([("a", 2), ("b", 1), ("a", 2)], "brand string, n int")
    report = json.loads(sinks.duplicate_report(items, F.col("brand"), F.col("n")).first().report)
    assert report["canonical"] == 3 and report["detections"] == 5 and report["top_brands"][0] == {"brand": "a", "n": 4}
    assert "- **n**: 2" in sinks.markdown("Report", items.limit(1))
    blobs = spark.createDataFrame([("a b?.png", bytearray(b"x"))], "name string, content binary")
    sinks.copy_files(blobs, str(tmp_path / "out"), F.col("name")).collect()
    assert os.listdir(tmp_path / "out") == ["a_b_.png"]


def test_first_available(spark):
    sources = {"x": spark.range(1).toDF("brand"), "y": spark.range(1).toDF("z")}
    assert files.first_available(sources, ["eye", "y"])[0] == "y"
    assert files.first_available(sources, ["eye"])[0] == "x"
    assert files.first_available({"y": sources["y"]}, []) is None


def test_provider_retries_and_reports(spark):
    class Flaky:
        schema = "id long, answer string"

        def open(self):
            self.calls = 0

        def answer(self, batch: pd.DataFrame) -> pd.DataFrame:
            self.calls += 1
            if 3 in batch["id"].tolist() or self.calls == 1:
                raise RuntimeError("busy")
            return pd.DataFrame({"id": batch["id"], "answer": "ok"})

    found = providers.ask(spark.range(6).coalesce(1), Flaky(), batch_size=2, retries=1, wait_s=0.01).collect()
    assert sorted(r.id for r in found if r.answer == "ok") == [0, 1, 4, 5]
    assert [r.error for r in found if r.error] == ["RuntimeError: busy"]
    fixed = providers.FixedProvider("id long", lambda b: b)
    assert providers.ask(spark.range(4), fixed, parallel=2).count() == 4


def test_regions_and_logos(spark):
    df = spark.sql("SELECT 'i' AS image_id, array(named_struct('name', 'x', 'boundingPoly', named_struct('vertices', array(named_struct('x', 1, 'y', 2), named_struct('x', 5, 'y', 9))))) AS texts, array(named_struct('brand', 'b', 'score', 0.9D), named_struct('brand', 'c', 'score', 0.1D)) AS logo_candidates")
    assert tuple(providers.labelled_regions(df).first().box) == (1, 2, 5, 9)
    assert [x.brand for x in providers.logos(df).first().logo_candidates] == ["b"]


def test_resume_processes_each_file_once(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = T.StructType().add("id", T.LongType())
    run = lambda: resume.process_new(spark, source, schema, target, log, lambda b: b.withColumn("twice", F.col("id") * 2))
    spark.range(3).write.parquet(source)
    assert run() >= 1
    spark.range(3, 5).write.mode("append").parquet(source)
    run()
    assert sorted(r.twice for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8]
    assert run() == 0


def test_backups(spark):
    df = spark.createDataFrame([(f"p{k}", k) for k in range(8)], "path string, made_at int")
    assert sorted(r.path for r in resume.backups_to_drop(df).collect()) == ["p0", "p1", "p2"]


def test_stream_of_windows(spark, small, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{small}/events.parquet").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).schema).parquet(source)
    query = resume.event_windows(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM hours").first()[0] == 1000


def test_command_line(spark, small, tmp_path, capsys):
    assert cli.main(["compare", "--input", small, "--config-check"]) == 0
    assert cli.main(["query", "--name", "portfolio_kpis", "--input", small, "--output", str(tmp_path / "o"), "--store", "store_a"]) == 0
    assert spark.read.parquet(str(tmp_path / "o/portfolio_kpis")).count() == 1
