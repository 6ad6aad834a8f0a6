"""A training-text pipeline over `documents`: quality, toxicity, near-duplicates, packing.

Every stage works on all rows its predecessor kept, and all but the last return the
columns of documents.  SQL cannot express the stages (EM, a trained classifier, MinHash
candidates, matching), so ORACLE_SQL is None and tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleforge.llm import minhash_dedup, packing, quality_votes, toxicity_fm
from aisleforge.operators.scratch import stored

ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Each row in one column beside its text, so that no further column can clash with an operator's own."""
    return docs.select(F.struct("*").alias("row"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose rules' votes make good quality likelier than not and that pass the base rule."""
    return quality_votes.judge(_rows(docs), keep=("row",)).filter("kept").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score under 0.5; learns from the labelled rows still there."""
    machine = toxicity_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_fm.score(_rows(docs), machine, keep=("row",)).filter(F.col("score") < 0.5).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id, and of repeated rows one."""
    return minhash_dedup.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near duplicates", near_duplicates), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
