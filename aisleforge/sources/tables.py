"""Domain views over the star schema: what a shelf-audit catalogue would hold, from lineitem and its dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The views as DuckDB SQL, for the oracle: put in front of a query that uses them.
PRODUCTS_SQL = """products AS (
  SELECT l_orderkey AS image_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS crop_id,
    CASE WHEN l_linestatus = 'O' THEN 'store_a' ELSE 'store_b' END AS supermarket,
    CASE WHEN p_brand = 'Brand#7' THEN 'unknown' WHEN p_brand = 'Brand#25' THEN NULL ELSE p_brand END AS brand,
    p_name AS product_type, CASE WHEN p_type = 'STANDARD' THEN 'Other Products' ELSE p_type END AS category,
    CASE r_name WHEN 'ASIA' THEN 'local' WHEN 'MIDDLE EAST' THEN 'unknown' ELSE 'international' END AS origin,
    round(1 - l_discount, 2) AS confidence, round(1 - l_tax, 2) AS conf_logo, round(1 - l_discount, 2) AS conf_ocr, l_quantity / 50 AS conf_detector,
    CAST(l_quantity AS BIGINT) AS facings, p_size AS size, s_suppkey AS supplier,
    CASE l_returnflag WHEN 'A' THEN 'Promo' WHEN 'R' THEN 'CategoryHeader' ELSE 'None' END AS signage,
    CASE WHEN l_linenumber = 1 THEN 'Endcap' WHEN l_linenumber = 2 THEN 'Checkout' WHEN l_linenumber = 3 THEN 'EyeLevel' ELSE 'None' END AS placement,
    p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS is_private, l_partkey AS part, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detected product; columns a query does not use are pruned down to the scans.

    region and nation have a fixed size and supplier and part are dimensions, so Spark picks broadcasts for
    those under its threshold and shuffles otherwise.
    """
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("l_orderkey").alias("image_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("crop_id"),
        F.when(F.col("l_linestatus") == "O", "store_a").otherwise("store_b").alias("supermarket"),
        F.when(F.col("p_brand") == "Brand#7", "unknown").when(F.col("p_brand") != "Brand#25", F.col("p_brand")).alias("brand"),
        F.col("p_name").alias("product_type"),
        F.when(F.col("p_type") == "STANDARD", "Other Products").otherwise(F.col("p_type")).alias("category"),
        F.when(F.col("r_name") == "ASIA", "local").when(F.col("r_name") == "MIDDLE EAST", "unknown").otherwise("international").alias("origin"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.round(1 - F.col("l_tax"), 2).alias("conf_logo"),
        F.round(1 - F.col("l_discount"), 2).alias("conf_ocr"),
        (F.col("l_quantity") / 50).alias("conf_detector"),
        F.col("l_quantity").cast("long").alias("facings"),
        F.col("p_size").alias("size"),
        F.col("s_suppkey").alias("supplier"),
        F.when(F.col("l_returnflag") == "A", "Promo").when(F.col("l_returnflag") == "R", "CategoryHeader").otherwise("None").alias("signage"),
        F.when(F.col("l_linenumber") == 1, "Endcap").when(F.col("l_linenumber") == 2, "Checkout").when(F.col("l_linenumber") == 3, "EyeLevel").otherwise("None").alias("placement"),
        F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3").alias("is_private"),
        F.col("l_partkey").alias("part"),
        F.col("l_linenumber").alias("line"),
    )
