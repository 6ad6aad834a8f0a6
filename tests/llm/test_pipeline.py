"""The corpus pipeline: every stage's decisions take effect on its own input."""

import random

import corpus_pipeline

from aisleforge.llm import minhash_dedup


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 7))) for _ in range(n)) + "."


def corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rng = random.Random(2)
    base = prose(rng, 150)
    words = base.split()
    words[10] = "changed"
    # rows of other ids, or of none, that are copies although another row with their id stays
    planted = [(10_004, base + " again"), (None, base + " more"), (10_001, base), (10_002, base), (10_003, " ".join(words)), (10_004, prose(rng, 200)), (10_005, "### $$$ ||| " * 80), (10_006, None), (None, prose(rng, 120))]
    rows = [(k, t, "en", "planted", len(t or "")) for k, t in planted]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({"kept": docs["lang"], "score": docs["lang"], "votes": docs["lang"]})


def test_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "best-fit packing"]
    docs = corpus(spark, small)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small).cache()
        assert after.columns == columns
        before_ids, ids = ([r[0] for r in d.select("doc_id").collect()] for d in (docs, after))
        assert set(ids) <= set(before_ids)
        if name == "quality rules":
            assert 10_005 not in ids and 10_006 not in ids and 10_004 in ids and None in ids
        if name == "near duplicates":
            assert 10_001 in ids and 10_002 not in ids and 10_003 not in ids and 10_004 in ids and None in ids
            assert all(r["kept"] for r in minhash_dedup.near_duplicates(after).collect())
            assert sum(ids.count(k) for k in (10_001, 10_004, None)) == 3
        assert 0.7 * len(before_ids) <= len(ids)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == set(ids)


def test_run(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r[0] for r in found.select("doc_id").distinct().collect()}
    assert len(ids) > 100 and ids <= {r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert found.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").isEmpty()
