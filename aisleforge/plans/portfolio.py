"""Portfolio reports: counts, ratios, concentration, variety, depth, shares."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import rules as R
from ..sources.tables import products
from .registry import query, register

KPI_SQL = """SELECT supermarket, count(*) AS products, count(DISTINCT brand) AS brands, count(DISTINCT category) AS categories, count(DISTINCT product_type) AS types,
  count(*) FILTER (origin = 'local') AS local_products, count(*) FILTER (origin = 'international') AS international_products FROM products GROUP BY supermarket"""


@query(KPI_SQL)
def portfolio_kpis(spark, sf_dir):
    return M.portfolio(products(spark, sf_dir))


@query(f"""WITH k AS ({KPI_SQL})
SELECT supermarket, round(products / brands, 6) AS products_per_brand, round(products / categories, 6) AS products_per_category, round(brands / categories, 6) AS brands_per_category,
  round(local_products * 100.0::DOUBLE / products, 6) AS local_pct, round(international_products * 100.0::DOUBLE / products, 6) AS international_pct FROM k""")
def portfolio_ratios(spark, sf_dir):
    return M.portfolio(products(spark, sf_dir)).select(
        "supermarket", M.ratio(F.col("products"), F.col("brands")).alias("products_per_brand"), M.ratio(F.col("products"), F.col("categories")).alias("products_per_category"),
        M.ratio(F.col("brands"), F.col("categories")).alias("brands_per_category"), M.ratio(F.col("local_products"), F.col("products"), 100).alias("local_pct"), M.ratio(F.col("international_products"), F.col("products"), 100).alias("international_pct"),
    )


def _hhi_sql(key: str, by: str, name: str, known: bool, factor: str = "1") -> str:
    total = f"sum(n) FILTER ({key} IS NOT NULL)" if known else "sum(n)"
    return f"WITH c AS (SELECT {by}, {key}, count(*) AS n FROM products GROUP BY ALL) SELECT {by}, round(CAST(sum(n * n) FILTER ({key} IS NOT NULL) AS DOUBLE) / pow(CAST({total} AS DOUBLE), 2) * {factor}, 6) AS {name} FROM c GROUP BY {by}"


register("brand_hhi_store", lambda s, d: M.hhi(products(s, d), "brand", ["supermarket"]), _hhi_sql("brand", "supermarket", "hhi", False))
register("brand_hhi_known", lambda s, d: M.hhi(products(s, d), "brand", ["supermarket"], known_only=True), _hhi_sql("brand", "supermarket", "hhi", True))
register("category_hhi", lambda s, d: M.hhi(products(s, d), "brand", ["supermarket", "category"]), _hhi_sql("brand", "supermarket, category", "hhi", False))
register("brand_focus", lambda s, d: M.hhi(products(s, d), "brand", ["supermarket"], "focus", factor=100.0), _hhi_sql("brand", "supermarket", "focus", False, "100"))


@query(_hhi_sql("brand", "category", "hhi", False).replace("SELECT category, round", "SELECT category, CASE WHEN h < 0.1 THEN 'diverse' WHEN h < 0.2 THEN 'moderate' ELSE 'concentrated' END AS band FROM (SELECT category, round").replace(" AS hhi FROM c GROUP BY category", " AS h FROM c GROUP BY category)"))
def hhi_bands(spark, sf_dir):
    found = M.hhi(products(spark, sf_dir), "brand", ["category"])
    return found.select("category", M.band(F.col("hhi"), [(0.1, "diverse"), (0.2, "moderate")], "concentrated").alias("band"))


@query("SELECT supermarket, category, round(CAST(count(DISTINCT brand) * count(DISTINCT product_type) AS DOUBLE) / count(*), 6) AS variety FROM products GROUP BY ALL")
def variety_index(spark, sf_dir):
    return products(spark, sf_dir).groupBy("supermarket", "category").agg(M.ratio(F.countDistinct("brand") * F.countDistinct("product_type"), F.count("*")).alias("variety"))


@query("WITH c AS (SELECT category, product_type, count(DISTINCT part) AS skus FROM products GROUP BY ALL) SELECT category, round(CAST(sum(skus) AS DOUBLE) / count(*), 6) AS variety FROM c GROUP BY category")
def variety_index_subcat(spark, sf_dir):
    per = products(spark, sf_dir).groupBy("category", "product_type").agg(F.countDistinct("part").alias("skus"))
    return per.groupBy("category").agg(M.ratio(F.sum("skus"), F.count("*")).alias("variety"))


@query("""WITH c AS (SELECT supermarket, brand || '/' || product_type AS line, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY ALL)
SELECT supermarket, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean_depth, max(n) AS max_depth, count(*) FILTER (n = 1) AS single, count(*) FILTER (n >= 10) AS deep FROM c GROUP BY supermarket""")
def assortment_depth(spark, sf_dir):
    lines = products(spark, sf_dir).filter("brand IS NOT NULL").groupBy("supermarket", F.concat_ws("/", "brand", "product_type").alias("line")).agg(F.count("*").alias("n"))
    return lines.groupBy("supermarket").agg(M.ratio(F.sum("n"), F.count("*")).alias("mean_depth"), F.max("n").alias("max_depth"), M.count_where(F.col("n") == 1).alias("single"), M.count_where(F.col("n") >= 10).alias("deep"))


@query("WITH c AS (SELECT supermarket, category, count(*) AS n FROM products GROUP BY ALL) SELECT supermarket, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS dominance FROM c GROUP BY supermarket")
def dominance(spark, sf_dir):
    return products(spark, sf_dir).groupBy("supermarket", "category").agg(F.count("*").alias("n")).groupBy("supermarket").agg(M.ratio(F.max("n"), F.sum("n")).alias("dominance"))


EDGES = {
    "brand_size_buckets_edges": [("1", 1, 1), ("2-4", 2, 4), ("5-9", 5, 9), ("10-19", 10, 19), ("20+", 20, None)],
    "brand_size_buckets_4": [("1", 1, 1), ("2-4", 2, 4), ("5-9", 5, 9), ("10+", 10, None)],
    "brand_size_buckets_10plus": [("10+", 10, None), ("3-9", 3, 9), ("2", 2, 2), ("1", 1, 1)],
}


def _lines(spark, sf_dir):
    return products(spark, sf_dir).select("supermarket", F.concat_ws("/", "brand", "product_type").alias("line_name"))


for _name, _edges in EDGES.items():
    _case = " ".join(f"WHEN n >= {lo}" + (f" AND n <= {hi}" if hi else "") + f" THEN '{label}'" for label, lo, hi in _edges)
    register(_name, lambda s, d, e=_edges: M.size_buckets(_lines(s, d), "line_name", ["supermarket"], e), f"WITH c AS (SELECT supermarket, concat_ws('/', brand, product_type) AS k, count(*) AS n FROM products GROUP BY ALL) SELECT supermarket, CASE {_case} END AS bucket, count(*) AS keys FROM c GROUP BY ALL")

ORIGINS = ["local", "international", "unknown"]


@query("SELECT category, " + ", ".join(f"count(*) FILTER (origin = '{o}') AS {o}" for o in ORIGINS) + " FROM products GROUP BY category")
def origin_crosstab(spark, sf_dir):
    return M.crosstab(products(spark, sf_dir), "category", "origin", ORIGINS)


@query("WITH c AS (SELECT category, origin, count(*) AS n FROM products GROUP BY ALL) SELECT category, origin, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY category), 6) AS pct FROM c")
def origin_crosstab_pct(spark, sf_dir):
    counted = products(spark, sf_dir).groupBy("category", "origin").agg(F.count("*").alias("n"))
    return M.with_share(counted, "n", "pct", ["category"], 100).drop("n")


@query("SELECT category, count(*) FILTER (supermarket = 'store_a') AS store_a, count(*) FILTER (supermarket = 'store_b') AS store_b, count(*) AS total FROM products GROUP BY category")
def store_category_pivot(spark, sf_dir):
    return M.crosstab(products(spark, sf_dir), "category", "supermarket", ["store_a", "store_b"]).withColumn("total", F.col("store_a") + F.col("store_b"))


@query("""SELECT category, count(*) AS products, count(DISTINCT product_type) AS types, count(*) FILTER (origin = 'local') AS local_products, count(*) - count(*) FILTER (origin = 'local') AS other_products,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share_pct FROM products GROUP BY category""")
def category_performance(spark, sf_dir):
    counted = products(spark, sf_dir).groupBy("category").agg(F.count("*").alias("products"), F.countDistinct("product_type").alias("types"), M.count_where(F.col("origin") == "local").alias("local_products"))
    return M.with_share(counted.withColumn("other_products", F.col("products") - F.col("local_products")), "products", "share_pct", factor=100, places=1)


@query("SELECT category, count(*) AS products, count(DISTINCT product_type) AS variety, round(CAST(count(*) AS DOUBLE) / count(DISTINCT product_type), 1) AS per_type FROM products GROUP BY category")
def category_stats(spark, sf_dir):
    return products(spark, sf_dir).groupBy("category").agg(F.count("*").alias("products"), F.countDistinct("product_type").alias("variety"), M.ratio(F.count("*"), F.countDistinct("product_type"), places=1).alias("per_type"))


@query("SELECT category, origin, count(*) AS products, count(DISTINCT brand) AS brands, round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(confidence), 6) AS mean_confidence FROM products GROUP BY ALL")
def category_confidence(spark, sf_dir):
    return products(spark, sf_dir).groupBy("category", "origin").agg(F.count("*").alias("products"), F.countDistinct("brand").alias("brands"), M.mean("confidence").alias("mean_confidence"))


@query("SELECT category, round(count(*) FILTER (is_private) * 100.0::DOUBLE / count(*), 6) AS private_pct FROM products GROUP BY category HAVING count(*) >= 5")
def private_penetration(spark, sf_dir):
    found = products(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), M.ratio(M.count_where(F.col("is_private")), F.count("*"), 100).alias("private_pct"))
    return found.filter("n >= 5").drop("n")


@query("SELECT supermarket, count(*) FILTER (regexp_matches(brand, '(?i)brand#1|brand#2$')) AS private_products, round(count(*) FILTER (regexp_matches(brand, '(?i)brand#1|brand#2$')) / count(*)::DOUBLE, 6) AS private_share FROM products GROUP BY supermarket")
def private_share(spark, sf_dir):
    hit = F.coalesce(F.col("brand").rlike("(?i)brand#1|brand#2$"), F.lit(False))
    return products(spark, sf_dir).groupBy("supermarket").agg(M.count_where(hit).alias("private_products"), M.ratio(M.count_where(hit), F.count("*")).alias("private_share"))


@query("""SELECT count(*) AS products, count(DISTINCT brand) AS brands, count(DISTINCT category) AS categories, count(DISTINCT image_id) AS images,
  round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(confidence), 6) AS mean_confidence, count(*) FILTER (confidence >= 0.95) AS sure FROM products WHERE brand IS NOT NULL AND lower(brand) NOT IN ('unknown', 'unidentified', 'n/a', 'none', '')""")
def executive_kpis(spark, sf_dir):
    known = products(spark, sf_dir).filter(M.known(F.col("brand")))
    return known.agg(F.count("*").alias("products"), F.countDistinct("brand").alias("brands"), F.countDistinct("category").alias("categories"), F.countDistinct("image_id").alias("images"), M.mean("confidence").alias("mean_confidence"), M.count_where(F.col("confidence") >= 0.95).alias("sure"))


@query("WITH k AS (SELECT supermarket, count(*) AS n, count(DISTINCT brand) AS b FROM products GROUP BY supermarket) SELECT supermarket, round(b * 1000.0::DOUBLE / n, 6) AS brands_per_1000, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS market_pct FROM k")
def market_share(spark, sf_dir):
    counted = products(spark, sf_dir).groupBy("supermarket").agg(F.count("*").alias("n"), F.countDistinct("brand").alias("b")).withColumn("brands_per_1000", M.ratio(F.col("b"), F.col("n"), 1000))
    return M.with_share(counted, "n", "market_pct", factor=100).select("supermarket", "brands_per_1000", "market_pct")


@query("WITH c AS (SELECT brand, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY brand) SELECT brand, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM c")
def brand_value_counts(spark, sf_dir):
    return M.value_counts(products(spark, sf_dir), "brand")


@query("SELECT brand, count(*) AS volume, count(DISTINCT product_type) AS variety FROM products WHERE brand IS NOT NULL GROUP BY brand HAVING count(*) > 1 AND count(DISTINCT category) > 1")
def brand_volume_variety(spark, sf_dir):
    """Volume and variety of a brand in one grouping, where two aggregates joined on the brand would shuffle twice."""
    found = products(spark, sf_dir).filter("brand IS NOT NULL").groupBy("brand").agg(F.count("*").alias("volume"), F.countDistinct("product_type").alias("variety"), F.countDistinct("category").alias("categories"))
    return found.filter("volume > 1 AND categories > 1").drop("categories")


SHARES = "WITH c AS (SELECT category, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS s, count(DISTINCT brand) AS b FROM products GROUP BY category)"


def _shares(spark, sf_dir):
    counted = products(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("brand").alias("b"))
    return counted.withColumn("s", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()))


@query(SHARES + " SELECT category, round(s, 6) AS share, CASE WHEN s >= 20 THEN 'Destination' WHEN s >= 10 THEN 'Core' WHEN s >= 5 THEN 'Complement' ELSE 'Niche' END AS role FROM c")
def market_share_roles_a(spark, sf_dir):
    return _shares(spark, sf_dir).select("category", F.round("s", 6).alias("share"), R.share_role(F.col("s")).alias("role"))


@query(SHARES + " SELECT category, b AS brands, CASE WHEN s > 20 AND b > 5 THEN 'Destination' WHEN s > 10 AND b > 3 THEN 'Routine' WHEN b > 2 THEN 'Convenience' ELSE 'Niche' END AS role FROM c")
def market_share_roles_b(spark, sf_dir):
    return _shares(spark, sf_dir).select("category", F.col("b").alias("brands"), R.share_role_with_brands(F.col("s"), F.col("b")).alias("role"))


@query("SELECT CASE WHEN regexp_matches(b, '(?i)#1') THEN 'local' WHEN regexp_matches(b, '(?i)#2') THEN 'international' ELSE 'unknown' END AS guess, count(*) AS brands FROM (SELECT DISTINCT brand AS b FROM products WHERE brand IS NOT NULL) GROUP BY 1")
def brand_origin_counts(spark, sf_dir):
    guess = F.when(F.col("brand").rlike("(?i)#1"), "local").when(F.col("brand").rlike("(?i)#2"), "international").otherwise("unknown")
    return products(spark, sf_dir).filter("brand IS NOT NULL").select("brand").distinct().groupBy(guess.alias("guess")).agg(F.count("*").alias("brands"))


@query("""WITH c AS (SELECT brand, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY brand), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, brand) AS k FROM c)
SELECT brand, n FROM r WHERE k <= 10 UNION ALL SELECT 'Others', CAST(sum(n) AS BIGINT) FROM r WHERE k > 10 HAVING count(*) > 0""")
def topn_others(spark, sf_dir):
    return M.top_n_others(products(spark, sf_dir), "brand", 10)


@query("""SELECT origin, count(*) AS products, CAST(sum(facings) AS BIGINT) AS weight, round(count(*) FILTER (placement IN ('EyeLevel', 'Endcap')) * 100.0::DOUBLE / count(*), 1) AS premium_pct,
  round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(confidence), 3) AS mean_confidence, count(DISTINCT brand) AS brands, count(DISTINCT category) AS categories FROM products GROUP BY origin""")
def origin_summary(spark, sf_dir):
    return products(spark, sf_dir).groupBy("origin").agg(
        F.count("*").alias("products"), F.sum("facings").alias("weight"), M.ratio(M.count_where(F.col("placement").isin("EyeLevel", "Endcap")), F.count("*"), 100, 1).alias("premium_pct"),
        M.mean("confidence", 3).alias("mean_confidence"), F.countDistinct("brand").alias("brands"), F.countDistinct("category").alias("categories"),
    )


COUNTING = "brand IS NOT NULL AND lower(brand) <> 'unknown' AND confidence >= 0.5"


@query(f"""SELECT brand, count(*) AS products, CAST(sum(facings) AS BIGINT) AS instances, array_to_string(list_sort(list(DISTINCT product_type)), '|') AS types, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories,
  round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(confidence), 6) AS mean_confidence, bool_or(is_private) AS private, round(CAST(count(DISTINCT part) AS DOUBLE) / CAST(sum(facings) AS DOUBLE), 3) AS diversity FROM products WHERE {COUNTING} GROUP BY brand""")
def brand_product_counts(spark, sf_dir):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return products(spark, sf_dir).filter(COUNTING).groupBy("brand").agg(
        F.count("*").alias("products"), F.sum("facings").alias("instances"), joined("product_type").alias("types"), joined("category").alias("categories"),
        M.mean("confidence").alias("mean_confidence"), F.bool_or("is_private").alias("private"), M.ratio(F.countDistinct("part"), F.sum("facings"), places=3).alias("diversity"),
    )


@query(f"""WITH b AS (SELECT brand, count(*) AS n, bool_or(is_private) AS p FROM products WHERE {COUNTING} GROUP BY brand)
SELECT count(*) AS brands, CAST(sum(n) AS BIGINT) AS products, round(count(*) FILTER (p) * 100.0::DOUBLE / count(*), 6) AS private_pct, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS per_brand,
  (SELECT string_agg(brand || ':' || n, '|' ORDER BY n DESC, brand) FROM (SELECT * FROM b ORDER BY n DESC, brand LIMIT 10)) AS top FROM b""")
def brand_statistics(spark, sf_dir):
    per = products(spark, sf_dir).filter(COUNTING).groupBy("brand").agg(F.count("*").alias("n"), F.bool_or("is_private").alias("p"))
    top = per.orderBy(F.desc("n"), "brand").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "brand"))).alias("x")).select(F.array_join(F.transform("x", lambda t: F.concat(t["brand"], F.lit(":"), (-t["m"]).cast("string"))), "|").alias("top"))
    total = per.agg(F.count("*").alias("brands"), F.sum("n").alias("products"), M.ratio(M.count_where(F.col("p")), F.count("*"), 100).alias("private_pct"), M.ratio(F.sum("n"), F.count("*")).alias("per_brand"))
    return total.crossJoin(top)  # one row each


@query("SELECT part AS k, count(*) AS n FROM products GROUP BY part ORDER BY n DESC, part LIMIT 12")
def topk_parts(spark, sf_dir):
    return M.top_k(products(spark, sf_dir), "part", 12).withColumnRenamed("part", "k")


@query("""WITH m AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM products) SELECT CAST(least(floor((confidence - lo) / (hi - lo) * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM products, m GROUP BY 1""")
def histogram20(spark, sf_dir):
    return M.histogram(products(spark, sf_dir), "confidence", 20)


@query("WITH p AS (SELECT confidence FROM products WHERE confidence <> 0.95 OR NOT EXISTS (SELECT 1 FROM products WHERE confidence <> 0.95)) SELECT confidence, count(*) AS n FROM p GROUP BY confidence")
def conditional_histogram(spark, sf_dir):
    """Leaves the default value out of a histogram, but only if there are others."""
    counts = products(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("n"))
    others = F.max((F.col("confidence") != 0.95).cast("int")).over(Window.partitionBy())
    return counts.withColumn("o", others).filter("confidence <> 0.95 OR o = 0").drop("o")


@query("WITH u AS (SELECT *, row_number() OVER (PARTITION BY supermarket ORDER BY n DESC, brand) AS k FROM (SELECT supermarket, brand, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY ALL)) SELECT brand, CAST(sum(n) AS BIGINT) AS n FROM u WHERE k <= 5 GROUP BY brand ORDER BY n DESC, brand LIMIT 8")
def union_top5(spark, sf_dir):
    p = products(spark, sf_dir)
    tops = [M.top_k(p.filter(F.col("supermarket") == s), "brand", 5) for s in ("store_a", "store_b")]
    return tops[0].unionByName(tops[1]).groupBy("brand").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "brand").limit(8)
