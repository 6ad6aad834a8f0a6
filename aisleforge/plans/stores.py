"""Queries through the library's own stores: replaced tables and matrices, read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..functions import scores, text
from ..operators import rules as R
from ..operators.scratch import fresh_folder
from ..sinks import matrix, snapshots
from ..sources import files
from ..sources.tables import products, table
from . import tables as T
from .registry import query


@query("SELECT coalesce(CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STANDARD.items()) + " END, 'Other Products') AS category, count(*) AS n FROM products GROUP BY 1")
def replaced_in_place(spark, sf_dir):
    """A table whose categories are standardised in place: it is read, and replaced by what was computed from it."""
    folder = fresh_folder(spark, "catalogue")
    snapshots.replace(products(spark, sf_dir).select("crop_id", "category"), folder)
    held = snapshots.read(spark, folder)
    snapshots.replace(held.withColumn("category", F.coalesce(R.mapped(F.col("category"), T.STANDARD, "Other Products"), F.lit("Other Products"))), folder)
    return snapshots.read(spark, folder).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS row, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, vec_id % 50 = 0 AS asked FROM embeddings",
    products=False,
)
def embedding_matrix(spark, sf_dir):
    """All vectors written as a matrix with its index and read back; every fiftieth is looked up by its id besides."""
    vectors, folder = table(spark, sf_dir, "embeddings"), fresh_folder(spark, "matrix")
    matrix.write_matrix(vectors, folder)
    asked = matrix.lookup(vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id")), folder).select("row", F.col("vector").alias("found"))
    read = matrix.read_matrix(spark, folder).join(asked, "row", "left")
    same = F.coalesce(F.col("found") == F.col("vector"), F.lit(False))
    return read.select("id", "row", F.col("vector")[0].cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"), same.alias("asked"))


@query(
    "SELECT 'Deduped Summary' AS sheet, category AS name, CAST(count(*) AS DOUBLE) AS n, CAST(sum(facings) AS DOUBLE) AS facings FROM products GROUP BY category UNION ALL SELECT 'KPIs', 'findings', CAST(count(*) AS DOUBLE), CAST(sum(facings) AS DOUBLE) FROM products UNION ALL SELECT 'All Findings', brand, CAST(count(*) AS DOUBLE), CAST(sum(facings) AS DOUBLE) FROM products GROUP BY brand"
)
def audit_workbook(spark, sf_dir):
    """A workbook of findings, summary, figures and, as there are none, no sheet of issues; written, read back and added up."""
    p = products(spark, sf_dir).select("crop_id", "brand", "category", "facings")
    figures = [F.count("*").alias("n"), F.sum("facings").alias("facings")]
    sheets = {"All Findings": p, "Deduped Summary": p.groupBy(F.col("category").alias("name")).agg(*figures), "KPIs": p.agg(*figures).withColumn("name", F.lit("findings")), "Issues": p.filter("facings < 0")}
    path = f"{fresh_folder(spark, 'audit')}/book.xlsx"
    sinks.excel(sheets, path, skip_empty=("Issues",), split=True)
    found = files.workbook(spark, path, joined=True)
    summed = found["All Findings"].groupBy(F.col("brand").alias("name")).agg(F.count("*").cast("double").alias("n"), F.sum("facings").alias("facings"))
    parts = {**{k: v.select("name", "n", "facings") for k, v in found.items() if k != "All Findings"}, "All Findings": summed}
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("sheet"), "name", "n", "facings") for k, df in parts.items()])


WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'new', 'fresh'))"


@query(
    f"SELECT doc_id, lower(concat_ws(' ', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE nullif(trim(source), '') END, nullif(trim(lang), ''), {WORDS}[1], {WORDS}[2], {WORDS}[3], {WORDS}[4], {WORDS}[5])) AS features FROM documents",
    products=False,
)
def feature_texts(spark, sf_dir):
    """The text that a product's embedding is made of: brand unless unknown, type, and the first five telling words."""
    brand = F.when(F.col("doc_id") % 3 == 0, "Unknown").otherwise(F.col("source"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", scores.feature_text(brand, F.col("lang"), None, words).alias("features"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') AS file_stamp FROM events", products=False)
def timestamps(spark, sf_dir):
    """Time stamps as reports and as file names carry them."""
    return table(spark, sf_dir, "events").select("event_id", text.stamp(F.col("ts")).alias("stamp"), text.file_stamp(F.col("ts")).alias("file_stamp"))
