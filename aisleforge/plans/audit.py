"""Shelf-audit reports: records, category summaries, roles, issues, hierarchy, majority votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..functions import scores, text
from ..operators import measures as M
from ..operators import relations as J
from ..operators import rules as R
from ..sources.tables import products, table
from .registry import query

CONF_SQL = "CAST(round(CAST(conf_logo AS DECIMAL(10,6)) * 0.4 + CAST(conf_ocr AS DECIMAL(10,6)) * 0.35 + CAST(conf_detector AS DECIMAL(10,6)) * 0.15, 3) AS DOUBLE)"


@query(f"SELECT crop_id, {CONF_SQL} AS conf_overall, {CONF_SQL} < 0.75 AS review_needed FROM products")
def confidence_fusion(spark, sf_dir):
    p = products(spark, sf_dir).withColumn("conf_overall", scores.overall_confidence(F.col("conf_logo"), F.col("conf_ocr"), F.col("conf_detector")))
    return p.select("crop_id", "conf_overall", scores.needs_review(F.col("conf_overall")).alias("review_needed"))


@query("SELECT DISTINCT brand, product_type, size, substring(md5(lower(concat_ws('|', coalesce(brand, ''), product_type, CAST(size AS VARCHAR)))), 1, 12) AS sku FROM products")
def sku_id(spark, sf_dir):
    return products(spark, sf_dir).select("brand", "product_type", "size").distinct().withColumn("sku", text.sku_id(F.col("brand"), F.col("product_type"), F.col("size").cast("string")))


@query("""SELECT crop_id, round(least(1.0, greatest(0.0, confidence - 0.3 + CASE WHEN is_private THEN 0.05 ELSE 0.0 END + least(line * 0.05, 0.15) - CASE WHEN signage = 'Promo' THEN 0.15 ELSE 0.0 END)), 6) AS fused FROM products""")
def fused_confidence(spark, sf_dir):
    return products(spark, sf_dir).select("crop_id", F.round(scores.fused_confidence(F.col("confidence") - 0.3, F.col("is_private"), F.col("line"), F.col("signage") == "Promo"), 6).alias("fused"))


@query(f"""SELECT crop_id, coalesce(brand, '') AS brand, (placement IN ('Endcap', 'EyeLevel') OR signage IN ('Promo', 'Claim') OR conf_logo >= 0.9) AND {CONF_SQL} >= 0.75 AS highlight, is_private AND placement = 'EyeLevel' AS private_display,
  CASE WHEN placement = 'Endcap' THEN 'Endcap' WHEN placement = 'Checkout' OR signage = 'Price' THEN 'Checkout' WHEN signage IN ('CategoryHeader', 'Promo') THEN 'Front' ELSE 'Aisle' END AS zone FROM products""")
def highlight_zone(spark, sf_dir):
    conf = scores.overall_confidence(F.col("conf_logo"), F.col("conf_ocr"), F.col("conf_detector"))
    return products(spark, sf_dir).select(
        "crop_id", F.coalesce("brand", F.lit("")).alias("brand"), R.is_highlight(F.col("placement"), F.col("signage"), F.col("conf_logo"), conf).alias("highlight"),
        (F.col("is_private") & (F.col("placement") == "EyeLevel")).alias("private_display"), R.store_zone(F.col("placement"), F.col("signage")).alias("zone"),
    )


@query("""SELECT p.crop_id, p.image_id, o_orderstatus AS image_state, coalesce(c.c_mktsegment, 'none') AS family, coalesce(p.brand, '') AS brand, p.facings FROM products p JOIN orders ON p.image_id = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey""")
def audit_records(spark, sf_dir):
    """Results with their image's metadata (rows without it are left out) and an optional dimension with a default."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_custkey", F.col("o_orderstatus").alias("image_state"))
    family = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("family"))
    joined = products(spark, sf_dir).join(images, "image_id").join(family, "o_custkey", "left")
    return joined.select("crop_id", "image_id", "image_state", F.coalesce("family", F.lit("none")).alias("family"), F.coalesce("brand", F.lit("")).alias("brand"), "facings")


@query("""WITH s AS (SELECT category, product_type, brand, count(*) AS n, sum(facings) AS f FROM products GROUP BY ALL), t AS (SELECT category, product_type, sum(f) AS f FROM s GROUP BY ALL),
r AS (SELECT category, string_agg(product_type, '|' ORDER BY f DESC, product_type) AS top FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f DESC, product_type) AS k FROM t) WHERE k <= 5 GROUP BY category)
SELECT p.category, count(DISTINCT part) AS skus, CAST(sum(facings) AS BIGINT) AS facings, round(CAST(count(DISTINCT part) AS DOUBLE) / count(DISTINCT product_type), 3) AS depth,
  round(count(DISTINCT CASE WHEN is_private THEN part END) / count(DISTINCT part)::DOUBLE, 3) AS private_sku_share, round(count(*) FILTER (is_private) / count(DISTINCT part)::DOUBLE, 3) AS private_row_share,
  round(count(*) FILTER (signage = 'Promo') / count(*)::DOUBLE, 3) AS promo_rate, round(count(*) FILTER (placement = 'EyeLevel') / count(*)::DOUBLE, 3) AS eye_rate, any_value(r.top) AS top_types
FROM products p JOIN r ON p.category = r.category GROUP BY p.category""")
def audit_category_summary(spark, sf_dir):
    p = products(spark, sf_dir)
    rate = lambda c, places=3: M.ratio(M.count_where(c), F.count("*"), places=places)
    summary = p.groupBy("category").agg(
        F.countDistinct("part").alias("skus"), F.sum("facings").alias("facings"), M.ratio(F.countDistinct("part"), F.countDistinct("product_type"), places=3).alias("depth"),
        M.ratio(F.countDistinct(F.when(F.col("is_private"), F.col("part"))), F.countDistinct("part"), places=3).alias("private_sku_share"),
        M.ratio(M.count_where(F.col("is_private")), F.countDistinct("part"), places=3).alias("private_row_share"), rate(F.col("signage") == "Promo").alias("promo_rate"), rate(F.col("placement") == "EyeLevel").alias("eye_rate"),
    )
    top = M.top_k_per_group(p.groupBy("category", "product_type").agg(F.sum("facings").alias("f")), ["category"], "product_type", "f", 5)
    names = top.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("rank", "product_type"))).alias("x")).select("category", F.array_join("x.product_type", "|").alias("top_types"))
    return summary.join(names, "category")


@query("SELECT category, signage, count(*) AS banners FROM products WHERE signage <> 'None' GROUP BY ALL")
def banner_counts(spark, sf_dir):
    return products(spark, sf_dir).filter("signage <> 'None'").groupBy("category", "signage").agg(F.count("*").alias("banners"))


@query("SELECT category, string_agg(signage || '=' || n, ',' ORDER BY signage) AS banners FROM (SELECT category, signage, count(*) AS n FROM products WHERE signage <> 'None' GROUP BY ALL) GROUP BY category")
def banner_map(spark, sf_dir):
    counted = banner_counts(spark, sf_dir).groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signage", "banners")))).alias("m"))
    return counted.select("category", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("banners"))


@query(f"""SELECT count(*) AS findings, count(DISTINCT image_id) AS images, count(DISTINCT part) AS skus, count(DISTINCT brand) AS brands, count(*) FILTER ({CONF_SQL} < 0.75) AS reviews,
  round(count(DISTINCT CASE WHEN is_private THEN part END) / count(DISTINCT part)::DOUBLE, 3) AS private_sku_share FROM products""")
def audit_kpis(spark, sf_dir):
    conf = scores.overall_confidence(F.col("conf_logo"), F.col("conf_ocr"), F.col("conf_detector"))
    return products(spark, sf_dir).agg(
        F.count("*").alias("findings"), F.countDistinct("image_id").alias("images"), F.countDistinct("part").alias("skus"), F.countDistinct("brand").alias("brands"), M.count_where(conf < 0.75).alias("reviews"),
        M.ratio(F.countDistinct(F.when(F.col("is_private"), F.col("part"))), F.countDistinct("part"), places=3).alias("private_sku_share"),
    )


@query(f"SELECT crop_id, CASE WHEN {CONF_SQL} < 0.7 THEN 'Low Confidence' ELSE 'Review Required' END AS issue FROM products WHERE {CONF_SQL} < 0.75")
def audit_issues(spark, sf_dir):
    p = products(spark, sf_dir).withColumn("c", scores.overall_confidence(F.col("conf_logo"), F.col("conf_ocr"), F.col("conf_detector")))
    return p.filter("c < 0.75").select("crop_id", F.when(F.col("c") < 0.7, "Low Confidence").otherwise("Review Required").alias("issue"))


@query("""WITH c AS (SELECT category, supplier, sum(facings) AS f, count(*) FILTER (signage = 'CategoryHeader') AS h, count(*) FILTER (signage = 'Promo') / count(*)::DOUBLE AS p, count(*) FILTER (placement = 'Endcap') / count(*)::DOUBLE AS e, count(*) FILTER (placement = 'Checkout') / count(*)::DOUBLE AS k FROM products GROUP BY ALL)
SELECT category, supplier, CASE WHEN f > 50 AND h > 0 AND p < 0.2 THEN 'Destination' WHEN e > 0.2 OR k > 0.1 OR p > 0.4 THEN 'Impulse' WHEN f > 10 AND p < 0.4 THEN 'Routine' ELSE 'Unknown' END AS role FROM c""")
def category_role(spark, sf_dir):
    rate = lambda c: M.count_where(c) / F.count("*")
    found = products(spark, sf_dir).groupBy("category", "supplier").agg(F.sum("facings").alias("f"), M.count_where(F.col("signage") == "CategoryHeader").alias("h"), rate(F.col("signage") == "Promo").alias("p"), rate(F.col("placement") == "Endcap").alias("e"), rate(F.col("placement") == "Checkout").alias("k"))
    return found.select("category", "supplier", R.category_role(F.col("f"), F.col("h"), F.col("p"), F.col("e"), F.col("k")).alias("role"))


@query("""SELECT crop_id, concat_ws('; ', CASE WHEN brand IS NULL THEN 'no brand' END, CASE WHEN is_private AND origin = 'international' THEN 'private but international' END, CASE WHEN signage = 'Promo' AND placement = 'None' THEN 'promotion without place' END) AS notes,
  brand IS NULL OR (is_private AND origin = 'international') OR (signage = 'Promo' AND placement = 'None') AS review FROM products""")
def consistency_checks(spark, sf_dir):
    checks = {"no brand": F.col("brand").isNull(), "private but international": F.col("is_private") & (F.col("origin") == "international"), "promotion without place": (F.col("signage") == "Promo") & (F.col("placement") == "None")}
    notes = F.concat_ws("; ", *[F.when(c, note) for note, c in checks.items()])
    return products(spark, sf_dir).select("crop_id", notes.alias("notes"), (F.length(notes) > 0).alias("review"))


@query("SELECT crop_id, concat_ws(',', CASE WHEN confidence < 0 OR confidence > 0.97 THEN 'confidence' END, CASE WHEN facings < 5 THEN 'facings' END, CASE WHEN signage NOT IN ('Promo', 'None') THEN 'signage' END) AS problems FROM products WHERE confidence < 0 OR confidence > 0.97 OR facings < 5 OR signage NOT IN ('Promo', 'None')")
def domain_validation(spark, sf_dir):
    _, bad = model.quarantine(products(spark, sf_dir), model.problems(products(spark, sf_dir), {"confidence": (0, 0.97), "facings": (5, None)}, {"signage": ("Promo", "None")}))
    return bad.select("crop_id", F.array_join("problems", ",").alias("problems"))


@query("""SELECT category, product_type, brand, supplier % 4 AS quarter, count(*) AS products, CAST(sum(facings) AS BIGINT) AS facings, CAST(grouping(category, product_type, brand, supplier % 4) AS BIGINT) AS level FROM products WHERE brand IS NOT NULL GROUP BY ROLLUP (category, product_type, brand, supplier % 4)""")
def hierarchy_rollup(spark, sf_dir):
    p = products(spark, sf_dir).filter("brand IS NOT NULL").withColumn("quarter", F.col("supplier") % 4)
    return p.rollup("category", "product_type", "brand", "quarter").agg(F.count("*").alias("products"), F.sum("facings").alias("facings"), F.grouping_id().alias("level"))


@query("""WITH t AS (SELECT brand, product_type, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY ALL), b AS (SELECT brand, count(*) AS n, arg_max(crop_id, confidence * 1000000000.0 + part) AS x, max(confidence) AS c FROM products WHERE brand IS NOT NULL GROUP BY brand)
SELECT b.brand, b.n AS products, b.c AS best_confidence, string_agg(product_type || '=' || t.n, ',' ORDER BY product_type) AS types FROM t JOIN b USING (brand) GROUP BY ALL""")
def brand_level(spark, sf_dir):
    p = products(spark, sf_dir).filter("brand IS NOT NULL")
    types = p.groupBy("brand", "product_type").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    return types.groupBy("brand").agg(F.sum("n").alias("products"), F.max("c").alias("best_confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("product_type", "n"))), lambda t: F.concat(t["product_type"], F.lit("="), t["n"].cast("string"))), ",").alias("types"))


@query("""WITH c AS (SELECT category, brand, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, brand) AS k FROM c)
SELECT category, CAST(sum(n) AS BIGINT) AS products, count(*) AS brands, string_agg(brand, '|' ORDER BY k) FILTER (k <= 5) AS top_brands FROM r GROUP BY category""")
def category_level(spark, sf_dir):
    counted = products(spark, sf_dir).filter("brand IS NOT NULL").groupBy("category", "brand").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "brand")))
    top = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "brand"))))["brand"], "|")
    return ranked.groupBy("category").agg(F.sum("n").alias("products"), F.count("*").alias("brands"), top.alias("top_brands"))


@query("""WITH g AS (SELECT brand, product_type, supplier % 10 AS cluster, count(*) AS images, max(confidence) AS c FROM products WHERE brand IS NOT NULL GROUP BY ALL)
SELECT brand, product_type, count(*) AS clusters, round(CAST(sum(CAST(c AS DECIMAL(18,4))) AS DOUBLE) / count(c), 3) AS mean_confidence, CAST(sum(images) AS BIGINT) AS images, arg_max(cluster, c * 1000 - cluster) AS best, string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY cluster) AS ids FROM g GROUP BY ALL ORDER BY brand, clusters DESC""")
def brand_type_summary(spark, sf_dir):
    clusters = products(spark, sf_dir).filter("brand IS NOT NULL").groupBy("brand", "product_type", (F.col("supplier") % 10).alias("cluster")).agg(F.count("*").alias("images"), F.max("confidence").alias("c"))
    return clusters.groupBy("brand", "product_type").agg(
        F.count("*").alias("clusters"), M.mean("c", 3).alias("mean_confidence"), F.sum("images").alias("images"), F.max_by("cluster", F.struct(F.col("c"), -F.col("cluster"))).alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list("cluster")), lambda c: c.cast("string")), ",").alias("ids"),
    ).orderBy("brand", F.desc("clusters"))


ROLL = "SELECT {0}, count(DISTINCT part) AS kinds, CAST(sum(facings) AS BIGINT) AS images, round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(confidence), 3) AS mean_confidence FROM products WHERE brand IS NOT NULL GROUP BY {0}"


def _roll(spark, sf_dir, key):
    return products(spark, sf_dir).filter("brand IS NOT NULL").groupBy(key).agg(F.countDistinct("part").alias("kinds"), F.sum("facings").alias("images"), M.mean("confidence", 3).alias("mean_confidence")).orderBy(F.desc("kinds"), key)


@query(ROLL.format("brand"))
def brand_rollup(spark, sf_dir):
    return _roll(spark, sf_dir, "brand")


@query(ROLL.format("product_type"))
def type_rollup(spark, sf_dir):
    return _roll(spark, sf_dir, "product_type")


@query("""WITH c AS (SELECT part % 500 AS cluster, brand, count(*) FILTER (confidence >= 0.99) AS sure, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (sure > 0) DESC, CASE WHEN sure > 0 THEN sure ELSE n END DESC, brand) AS k FROM c)
SELECT cluster, brand FROM r WHERE k = 1""")
def majority_brand(spark, sf_dir):
    """The most frequent brand among sure detections of a cluster; without any, among all."""
    counted = products(spark, sf_dir).filter("brand IS NOT NULL").groupBy((F.col("part") % 500).alias("cluster"), "brand").agg(M.count_where(F.col("confidence") >= 0.99).alias("sure"), F.count("*").alias("n"))
    votes = counted.withColumn("voted", F.col("sure") > 0).withColumn("v", F.when(F.col("voted"), F.col("sure")).otherwise(F.col("n")))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("voted"), F.desc("v"), "brand"))
    return votes.withColumn("k", rank).filter("k = 1").select("cluster", "brand")


@query("SELECT crop_id, part, image_id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY confidence DESC, image_id, crop_id) AS k FROM products) WHERE k = 1")
def keep_first(spark, sf_dir):
    return J.keep_first(products(spark, sf_dir).withColumn("minus", -F.col("confidence")), ["part"], ["minus", "image_id", "crop_id"]).select("crop_id", "part", "image_id")
