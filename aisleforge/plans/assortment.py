"""Comparisons and sequences: joins, set overlaps, windows, category repair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scores
from ..operators import measures as M
from ..operators import relations as J
from ..operators import rules as R
from ..operators.scratch import fresh_folder
from ..sources.providers import FixedProvider, ask
from ..sources.tables import products, table
from ..streaming.resume import event_windows, progress, remaining
from ..streaming.state import progress_stream, run_to_end
from . import tables as T
from .registry import query


def _store(p, name):
    return p.filter(F.col("supermarket") == name)


@query("""WITH a AS (SELECT brand, count(*) AS n FROM products WHERE supermarket = 'store_a' AND brand IS NOT NULL GROUP BY brand), b AS (SELECT brand, count(*) AS n FROM products WHERE supermarket = 'store_b' AND brand IS NOT NULL GROUP BY brand)
SELECT coalesce(a.brand, b.brand) AS brand, coalesce(a.n, 0) AS store_a, coalesce(b.n, 0) AS store_b, coalesce(a.n, 0) + coalesce(b.n, 0) AS total FROM a FULL OUTER JOIN b ON a.brand = b.brand""")
def outer_align(spark, sf_dir):
    p = products(spark, sf_dir).filter("brand IS NOT NULL")
    a, b = (_store(p, s).groupBy("brand").agg(F.count("*").alias("n")) for s in ("store_a", "store_b"))
    return J.aligned(a, b, "brand", ("store_a", "store_b"))


@query("""WITH c AS (SELECT supermarket, brand, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY supermarket ORDER BY n DESC, brand) AS k FROM c)
SELECT a.brand, a.n AS store_a, coalesce(b.n, 0) AS store_b FROM (SELECT * FROM r WHERE supermarket = 'store_a' AND k <= 15) a LEFT JOIN (SELECT * FROM r WHERE supermarket = 'store_b' AND k <= 15) b ON a.brand = b.brand""")
def left_align_topk(spark, sf_dir):
    p = products(spark, sf_dir)
    a, b = (M.top_k(_store(p, s), "brand", 15).select("brand", F.col("n").alias(s)) for s in ("store_a", "store_b"))
    return a.join(b, "brand", "left").fillna(0, subset=["store_b"])


@query("""WITH d AS (SELECT DISTINCT product_type, category FROM products), m AS (SELECT product_type, max(category) AS c FROM d WHERE category <> 'Other Products' GROUP BY product_type)
SELECT d.product_type, d.category, CASE WHEN d.category = 'Other Products' THEN coalesce(m.c, d.category) ELSE d.category END AS repaired FROM d LEFT JOIN m ON d.product_type = m.product_type""")
def lookup_last_wins(spark, sf_dir):
    """Propagates the last known category of a product type to its open rows; the order here is the category's name."""
    d = products(spark, sf_dir).select("product_type", "category").distinct()
    pairs = d.filter("category <> 'Other Products'").withColumn("seq", F.col("category"))
    open_rows = J.lookup_last(d.filter("category = 'Other Products'").withColumn("repaired", F.col("category")), pairs.withColumnRenamed("category", "known"), "product_type", "known", "seq", "repaired")
    return open_rows.unionByName(d.filter("category <> 'Other Products'").withColumn("repaired", F.col("category")))


@query("SELECT crop_id, brand FROM products p WHERE EXISTS (SELECT 1 FROM (SELECT brand FROM products WHERE is_private GROUP BY brand) v WHERE v.brand = p.brand)")
def semi_variants(spark, sf_dir):
    p = products(spark, sf_dir)
    return p.select("crop_id", "brand").join(p.filter("is_private").select("brand").distinct(), "brand", "left_semi").select("crop_id", "brand")


@query("SELECT o_orderkey AS image_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)", products=False)
def anti_remaining(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    return remaining(images, table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("image_id")), "image_id")


SETS = "WITH a AS (SELECT DISTINCT {0} AS k FROM products WHERE supermarket = 'store_a'), b AS (SELECT DISTINCT {0} AS k FROM products WHERE supermarket = 'store_b'), s AS (SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared)"
SET_COLUMNS = "size_a, size_b, shared, size_a - shared AS only_a, size_b - shared AS only_b, round(shared * 100.0::DOUBLE / least(size_a, size_b), 6) AS overlap_pct"
LINE = "coalesce(brand, '?') || '/' || product_type"


def _two_sets(spark, sf_dir, key):
    p = products(spark, sf_dir).withColumn("k", key)
    return _store(p, "store_a"), _store(p, "store_b")


def _line():
    return F.concat(F.coalesce("brand", F.lit("?")), F.lit("/"), F.col("product_type"))


@query(SETS.format(LINE) + f" SELECT {SET_COLUMNS} FROM s")
def brand_overlap(spark, sf_dir):
    return J.set_sizes(*_two_sets(spark, sf_dir, _line()), "k")


@query(SETS.format("category") + f" SELECT {SET_COLUMNS} FROM s")
def category_overlap(spark, sf_dir):
    return J.set_sizes(*_two_sets(spark, sf_dir, F.col("category")), "k")


@query(SETS.format(LINE) + f", o AS (SELECT {SET_COLUMNS} FROM s) SELECT CASE WHEN overlap_pct < 30 THEN 'High' WHEN overlap_pct < 60 THEN 'Moderate' ELSE 'Low' END AS differentiation FROM o")
def overlap_band(spark, sf_dir):
    return J.set_sizes(*_two_sets(spark, sf_dir, _line()), "k").select(J.overlap_band(F.col("overlap_pct")).alias("differentiation"))


@query(f"WITH a AS (SELECT {LINE} AS k FROM products WHERE supermarket = 'store_a'), b AS (SELECT {LINE} AS k FROM products WHERE supermarket = 'store_b') SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'only_a' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'only_b' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def brand_set_operations(spark, sf_dir):
    a, b = (x.select("k") for x in _two_sets(spark, sf_dir, _line()))
    sides = {"both": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a)}
    found = [df.withColumn("side", F.lit(name)) for name, df in sides.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT brand, 'a' AS part_of, CAST(count(*) AS BIGINT) AS n, NULL AS extra FROM products WHERE supermarket = 'store_a' AND brand IS NOT NULL GROUP BY brand UNION ALL SELECT brand, 'b', count(*), CAST(sum(facings) AS BIGINT) FROM products WHERE supermarket = 'store_b' AND brand IS NOT NULL GROUP BY brand")
def union_by_name(spark, sf_dir):
    p = products(spark, sf_dir).filter("brand IS NOT NULL")
    a = _store(p, "store_a").groupBy("brand").agg(F.count("*").alias("n")).withColumn("part_of", F.lit("a"))
    b = _store(p, "store_b").groupBy("brand").agg(F.sum("facings").alias("extra"), F.count("*").alias("n")).withColumn("part_of", F.lit("b"))
    return a.unionByName(b, allowMissingColumns=True).select("brand", "part_of", "n", "extra")


@query("SELECT DISTINCT category AS value FROM products WHERE category NOT IN ('ECONOMY', 'LARGE', 'SMALL')")
def unmapped_values(spark, sf_dir):
    allowed = spark.createDataFrame([("ECONOMY",), ("LARGE",), ("SMALL",)], "category string")
    return J.unmapped(products(spark, sf_dir), "category", allowed).select(F.col("category").alias("value"))


@query("SELECT part, k, upper(product_type) || '/' || k AS answer FROM (SELECT part, product_type, row_number() OVER (PARTITION BY part // 20 ORDER BY part) - 1 AS k FROM (SELECT DISTINCT part, product_type FROM products))")
def positional_answers(spark, sf_dir):
    """Answers of a batch come as an array; each goes to the row of its position."""
    items = products(spark, sf_dir).select("part", "product_type").distinct().withColumn("batch", F.floor(F.col("part") / 20))
    ordered = items.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "product_type"))).alias("x"))
    answers = ordered.select("batch", F.transform("x", lambda x, k: F.concat(F.upper(x["product_type"]), F.lit("/"), k.cast("string"))).alias("answers"))
    return J.positional(answers, items, "batch", "answers", "part").select("part", F.col("pos").cast("long").alias("k"), "answer")


@query("WITH c AS (SELECT brand, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY brand), t AS (SELECT * FROM c ORDER BY n DESC, brand LIMIT 15) SELECT brand, n, round(sum(n) OVER (ORDER BY n DESC, brand ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / (SELECT count(*) FROM products), 6) AS cumulative_pct FROM t")
def pareto_brands(spark, sf_dir):
    p = products(spark, sf_dir)
    counts = p.groupBy("brand").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row; all rows count, also those without a brand
    top = counts.filter("brand IS NOT NULL").orderBy(F.desc("n"), "brand").limit(15)
    ahead = Window.orderBy(F.desc("n"), "brand").rowsBetween(Window.unboundedPreceding, 0)  # 15 rows
    return top.crossJoin(total).select("brand", "n", M.ratio(F.sum("n").over(ahead), F.col("total"), 100).alias("cumulative_pct"))


@query("WITH c AS (SELECT category, supermarket, count(*) AS n FROM products GROUP BY ALL) SELECT category, supermarket, n, round(n / sum(n) OVER (PARTITION BY supermarket)::DOUBLE, 6) AS share FROM c")
def share_of_total(spark, sf_dir):
    counted = products(spark, sf_dir).groupBy("category", "supermarket").agg(F.count("*").alias("n"))
    return M.with_share(counted, "n", "share", ["supermarket"])


@query("WITH c AS (SELECT category, brand, CAST(sum(facings) AS BIGINT) AS f FROM products WHERE brand IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT category, brand, f, CAST(row_number() OVER (PARTITION BY category ORDER BY f DESC, brand) AS INTEGER) AS rank FROM c) WHERE rank <= 5")
def topk_per_category(spark, sf_dir):
    counted = products(spark, sf_dir).filter("brand IS NOT NULL").groupBy("category", "brand").agg(F.sum("facings").alias("f"))
    return M.top_k_per_group(counted, ["category"], "brand", "f", 5)


PROGRESS = """WITH e AS (SELECT user_id, event_id, value, count(*) OVER a AS done, round(CAST(sum(CAST(value AS DECIMAL(18,4))) OVER a AS DOUBLE) / count(*) OVER a, 6) AS mean_all, round(CAST(sum(CAST(value AS DECIMAL(18,4))) OVER l AS DOUBLE) / count(*) OVER l, 6) AS mean_last5
  FROM events WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING))"""


@query(PROGRESS + " SELECT user_id, event_id, done, mean_all, mean_last5, CASE WHEN mean_last5 > mean_all * 1.1 THEN 'slower' WHEN mean_last5 < mean_all * 0.9 THEN 'faster' ELSE 'stable' END AS trend FROM e", products=False)
def trend_last5(spark, sf_dir):
    found = progress(table(spark, sf_dir, "events"), "event_id", "value", 100, ["user_id"])
    return found.select("user_id", "event_id", "done", "mean_all", "mean_last5", "trend")


@query(PROGRESS + " SELECT user_id, event_id, round(mean_all * greatest(100 - done, 0), 4) AS eta_s FROM e", products=False)
def running_eta(spark, sf_dir):
    return progress(table(spark, sf_dir, "events"), "event_id", "value", 100, ["user_id"]).select("user_id", "event_id", "eta_s")


@query(PROGRESS + " SELECT user_id, event_id, done, mean_all, mean_last5, round(mean_all * greatest(100 - done, 0), 4) AS eta_s, CASE WHEN mean_last5 > mean_all * 1.1 THEN 'slower' WHEN mean_last5 < mean_all * 0.9 THEN 'faster' ELSE 'stable' END AS trend FROM e", products=False)
def progress_state(spark, sf_dir):
    """Mean, remaining time and trend from streaming state: the events run as a stream to their end, and what it wrote is read."""
    events = table(spark, sf_dir, "events")
    # the pattern is for a table that is one file, which a stream takes for a folder otherwise
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    folder = fresh_folder(spark, "progress")
    run_to_end(progress_stream(stream, "user_id", "event_id", "value", 100), f"{folder}/rows", f"{folder}/log")
    return spark.read.parquet(f"{folder}/rows")


@query("SELECT user_id, count(*) AS items, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 6) AS mean_s, min(value) AS min_s, max(value) AS max_s FROM events GROUP BY user_id", products=False)
def image_timing(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("items"), M.mean("value").alias("mean_s"), F.min("value").alias("min_s"), F.max("value").alias("max_s"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", products=False)
def event_hours(spark, sf_dir):
    """Tumbling windows; the same function takes the stream with a watermark."""
    return event_windows(table(spark, sf_dir, "events"))


@query("SELECT url, printf('img%04d', row_number() OVER (ORDER BY url, page_id)) AS image_id FROM pages", products=False)
def sequential_ids(spark, sf_dir):
    from ..sources.files import with_sequence

    pages = table(spark, sf_dir, "pages").select("url", F.concat_ws("\u0001", "url", F.format_string("%012d", "page_id")).alias("path"))
    return with_sequence(pages, "path", "img%04d", "image_id").select("url", "image_id")


Y = "CAST(part % 1000 AS DOUBLE) / 1000"
ZONE = f"CASE WHEN {Y} <= 0.25 THEN 'top' WHEN {Y} <= 0.65 THEN 'eye' WHEN {Y} <= 0.75 THEN 'middle' ELSE 'bottom' END"


def _placed(spark, sf_dir):
    return products(spark, sf_dir).withColumn("y", (F.col("part") % 1000).cast("double") / 1000)


@query(f"SELECT crop_id, {ZONE} AS zone, {ZONE} IN ('eye', 'middle') AS premium FROM products")
def zone_assign(spark, sf_dir):
    return _placed(spark, sf_dir).withColumn("zone", scores.zone(F.col("y"))).select("crop_id", "zone", scores.premium(F.col("zone")).alias("premium"))


@query(f"SELECT crop_id, CAST(CASE WHEN line % 2 = 0 THEN CASE WHEN {Y} < 0.2 THEN 4 WHEN {Y} < 0.4 THEN 3 WHEN {Y} < 0.7 THEN 2 ELSE 1 END ELSE CASE WHEN {Y} >= 0.3 AND {Y} <= 0.7 THEN 2 WHEN {Y} < 0.3 THEN 3 ELSE 1 END END AS INTEGER) AS tier FROM products")
def shelf_tier(spark, sf_dir):
    return _placed(spark, sf_dir).select("crop_id", scores.shelf_tier(F.col("y"), F.col("line") % 2 == 0).alias("tier"))


@query(f"""WITH z AS (SELECT category, {Y} AS y, {ZONE} AS zone FROM products), n AS (SELECT category, zone, count(*) AS n FROM z GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, zone) AS k FROM n)
SELECT z.category, count(*) AS products, min(y) AS min_y, max(y) AS max_y, round(median(y), 6) AS median_y, round(stddev_pop(y), 6) AS std_y, any_value(c.zone) AS dominant FROM z JOIN c ON z.category = c.category AND c.k = 1 GROUP BY z.category""")
def zone_stats(spark, sf_dir):
    placed = _placed(spark, sf_dir).withColumn("zone", scores.zone(F.col("y")))
    stats = placed.groupBy("category").agg(F.count("*").alias("products"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.round(F.stddev_pop("y"), 6).alias("std_y"))
    zones = placed.groupBy("category", "zone").agg(F.count("*").alias("n"))
    first = zones.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "zone"))).filter("k = 1").select("category", F.col("zone").alias("dominant"))
    middle = M.median(placed, "y", ["category"]).select("category", F.round("median", 6).alias("median_y"))
    return stats.join(middle, "category").join(first, "category")


@query("""WITH p AS (SELECT DISTINCT image_id, (part % 100) AS s FROM products), g AS (SELECT image_id, s, CASE WHEN s - lag(s) OVER w > 10 THEN 1 ELSE 0 END AS f FROM p WINDOW w AS (PARTITION BY image_id ORDER BY s)),
i AS (SELECT image_id, s, sum(f) OVER (PARTITION BY image_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM g), z AS (SELECT *, count(*) OVER (PARTITION BY image_id, island) AS n, count(*) OVER (PARTITION BY image_id) AS a FROM i),
r AS (SELECT *, dense_rank() OVER (PARTITION BY image_id, n >= 2 ORDER BY island) AS k FROM z) SELECT image_id, s AS position, CAST(CASE WHEN a < 3 THEN 1 WHEN n < 2 THEN 1 ELSE least(k, 6) END AS INTEGER) AS tier FROM r""")
def tier_islands(spark, sf_dir):
    from ..operators.similarity import tiers

    points = products(spark, sf_dir).select("image_id", (F.col("part") % 100).alias("position")).distinct()
    return tiers(points, ["image_id"], "position", eps=10).select("image_id", "position", "tier")


def _words(rules, text):
    return " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in r.words) + f" THEN '{r.category}'" for r in rules)


@query(f"SELECT DISTINCT product_type, category, CASE WHEN category = 'Other Products' THEN CASE {_words(T.REPAIRS, 'lower(product_type)')} ELSE category END ELSE category END AS repaired FROM products")
def ordered_rules(spark, sf_dir):
    d = products(spark, sf_dir).select("product_type", "category").distinct()
    return R.repaired(d.withColumn("repaired", F.col("category")), "repaired", T.REPAIRS, F.col("product_type"))


@query(f"SELECT DISTINCT category, product_type, CASE WHEN category = 'Other Products' OR confidence < 0.93 THEN TRUE ELSE FALSE END AS open FROM products WHERE category = 'Other Products' OR confidence < 0.93")
def repair_population(spark, sf_dir):
    p = products(spark, sf_dir).filter((F.col("category") == "Other Products") | (F.col("confidence") < 0.93))
    return p.select("category", "product_type", F.lit(True).alias("open")).distinct()


def _in(table):
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())


@query(f"SELECT category, CASE category {_in({k: v for k, v in T.STANDARD.items() if k != 'PROMO'})} ELSE 'Other Products' END AS standard, count(*) AS n FROM products GROUP BY ALL")
def standardize(spark, sf_dir):
    table_map = {k: v for k, v in T.STANDARD.items() if k != "PROMO"}
    return products(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")).withColumn("standard", R.mapped(F.col("category"), table_map, "Other Products"))


@query(f"SELECT CASE category {_in(T.CONSOLIDATED)} ELSE 'Rest' END AS grouped, count(*) AS n, count(DISTINCT category) AS members FROM products GROUP BY 1")
def consolidate(spark, sf_dir):
    return products(spark, sf_dir).groupBy(R.mapped(F.col("category"), T.CONSOLIDATED, "Rest").alias("grouped")).agg(F.count("*").alias("n"), F.countDistinct("category").alias("members"))


@query("SELECT product_type, CASE WHEN regexp_matches(product_type, '(?i)bolt|ring') THEN 'Beverages' ELSE 'Food' END AS split, count(*) AS n FROM products GROUP BY ALL")
def keyword_split(spark, sf_dir):
    return products(spark, sf_dir).groupBy("product_type").agg(F.count("*").alias("n")).withColumn("split", F.when(F.col("product_type").rlike("(?i)bolt|ring"), "Beverages").otherwise("Food"))


@query(f"""WITH m AS (SELECT *, CASE WHEN category = 'Other Products' THEN CASE {_words(T.REPAIRS, 'lower(product_type)')} ELSE category END ELSE category END AS after FROM products), b AS (SELECT category AS k, count(*) AS n FROM m GROUP BY 1), a AS (SELECT after AS k, count(*) AS n FROM m GROUP BY 1)
SELECT coalesce(a.k, b.k) AS category, coalesce(b.n, 0) AS before_n, coalesce(a.n, 0) AS after_n, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL OUTER JOIN b ON a.k = b.k""")
def repair_before_after(spark, sf_dir):
    p = products(spark, sf_dir).groupBy("category", "product_type").agg(F.count("*").alias("n"))
    after = R.repaired(p, "category", T.REPAIRS, F.col("product_type"))
    both = J.aligned(p.groupBy("category").agg(F.sum("n").alias("n")), after.groupBy("category").agg(F.sum("n").alias("n")), "category", ("before_n", "after_n"))
    return both.select("category", "before_n", "after_n", (F.col("after_n") - F.col("before_n")).alias("change"))


@query("WITH d(k) AS (VALUES " + ", ".join(f"('{c}')" for c in T.FIXED_CATEGORIES) + "), c AS (SELECT category, supermarket, count(*) AS n FROM products GROUP BY ALL), t AS (SELECT supermarket, sum(n) AS t FROM c GROUP BY 1) SELECT k AS category, coalesce(a.n, 0) AS store_a, coalesce(b.n, 0) AS store_b, round(coalesce(a.n, 0) * 100.0::DOUBLE / (SELECT t FROM t WHERE supermarket = 'store_a'), 1) AS pct_a, round(coalesce(b.n, 0) * 100.0::DOUBLE / (SELECT t FROM t WHERE supermarket = 'store_b'), 1) AS pct_b, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference FROM d LEFT JOIN c a ON a.category = k AND a.supermarket = 'store_a' LEFT JOIN c b ON b.category = k AND b.supermarket = 'store_b'")
def category_comparison(spark, sf_dir):
    """Counts of a fixed list of categories in two stores; absent ones count 0."""
    counts = M.crosstab(products(spark, sf_dir), "category", "supermarket", ["store_a", "store_b"])
    shares = counts.select("category", "store_a", "store_b", *[M.ratio(F.col(f"store_{s}"), F.sum(f"store_{s}").over(Window.partitionBy()), 100, 1).alias(f"pct_{s}") for s in "ab"])
    listed = spark.createDataFrame([(c,) for c in T.FIXED_CATEGORIES], "category string")
    return listed.join(shares, "category", "left").fillna(0).withColumn("difference", F.col("store_a") - F.col("store_b"))


def _catalog_sql(text: str, exact: str) -> str:
    rows = ", ".join(f"({-k}, '{r.category}', [{', '.join(repr(w) for w in r.words)}])" for k, r in enumerate(T.CATALOG))
    return f"cat(place, name, words) AS (VALUES {rows}), d AS (SELECT DISTINCT product_type FROM products), h AS (SELECT product_type, place, name, len(words) AS w, list_sum(list_transform(words, lambda x: CASE WHEN contains({text}, x) THEN CASE WHEN {exact} = x THEN 3 ELSE 1 END ELSE 0 END)) AS n, len(list_filter(words, lambda x: contains({text}, x))) AS plain FROM d, cat)"


@query(f"WITH {_catalog_sql('lower(product_type)', 'lower(product_type)')}, s AS (SELECT *, CASE WHEN n > 1 THEN n / w::DOUBLE * 1.2 ELSE n / w::DOUBLE END AS c FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY c DESC, place DESC) AS k FROM s) SELECT product_type, CASE WHEN c >= 0.1 THEN name END AS category, round(CASE WHEN c >= 0.1 THEN c ELSE 0.0 END, 6) AS confidence FROM r WHERE k = 1")
def category_match_catalog(spark, sf_dir):
    d = products(spark, sf_dir).select("product_type").distinct().withColumn("m", R.catalog_match(F.col("product_type"), F.col("product_type"), T.CATALOG))
    return d.select("product_type", "m.category", F.round("m.confidence", 6).alias("confidence"))


@query(f"WITH {_catalog_sql('lower(product_type)', 'lower(product_type)')}, s AS (SELECT *, least(plain * 2 / w::DOUBLE, 1.0) AS c FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY c DESC, place DESC) AS k FROM s) SELECT product_type, CASE WHEN c > 0 THEN name ELSE 'other' END AS category, round(CASE WHEN c > 0 THEN c ELSE 0.3 END, 6) AS confidence FROM r WHERE k = 1")
def category_match_compact(spark, sf_dir):
    d = products(spark, sf_dir).select("product_type").distinct().withColumn("m", R.compact_match(F.col("product_type"), T.CATALOG))
    return d.select("product_type", "m.category", F.round("m.confidence", 6).alias("confidence"))


@query(f"WITH {_catalog_sql('lower(product_type)', 'lower(product_type)')}, v(name2, words) AS (VALUES {', '.join(f'({r.category!r}, [{', '.join(repr(w) for w in r.words)}])' for r in T.CATALOG)}) SELECT product_type, name2 AS category, round((list_sum(list_transform(words, lambda x: CASE WHEN product_type = x THEN 1.0 WHEN starts_with(product_type, x) OR ends_with(product_type, x) THEN 0.8 WHEN contains(product_type, x) THEN 0.6 ELSE 0.0 END))::DOUBLE + len(list_filter(words, lambda x: contains(product_type, x))) * 0.5::DOUBLE) / len(words), 6) AS score FROM d, v")
def rule_scores(spark, sf_dir):
    d = products(spark, sf_dir).select("product_type").distinct()
    scored = F.array(*[F.struct(F.lit(r.category).alias("category"), F.round(R.rule_score(F.col("product_type"), r.words), 6).alias("score")) for r in T.CATALOG])
    return d.select("product_type", F.inline(scored))


def _cascade_sql() -> str:
    held = lambda words: "[" + ", ".join(map(repr, words)) + "]"
    catalog = ", ".join(f"({k}, '{r.category}', {held(r.words)})" for k, r in enumerate(T.CASCADE))
    clusters = ", ".join(f"({k}, '{name}', {confidence}::DOUBLE, {held(t.split())})" for k, (name, confidence, types) in enumerate(T.CLUSTERS) for t in types)
    return f"""d AS (SELECT DISTINCT product_type AS p, string_split(lower(product_type), ' ') AS own FROM products), cat(place, name, words) AS (VALUES {catalog}), clu(place, name, sure, words) AS (VALUES {clusters}),
s AS (SELECT p, place, name, (list_sum(list_transform(words, lambda x: CASE WHEN p = x THEN 1.0 WHEN starts_with(p, x) OR ends_with(p, x) THEN 0.8 WHEN contains(p, x) THEN 0.6 ELSE 0.0 END))::DOUBLE + len(list_filter(words, lambda x: contains(p, x))) * 0.5::DOUBLE) / len(words) AS r,
list_transform(words, lambda x: len(list_intersect(own, string_split(x, ' ')))::DOUBLE / len(string_split(x, ' '))) AS shares FROM d, cat),
m AS (SELECT p, place, name, r, (list_sum(shares) / len(shares) + list_max(shares)) / 2 AS m FROM s),
rule AS (SELECT p, name, r AS sure FROM m QUALIFY row_number() OVER (PARTITION BY p ORDER BY r DESC, place) = 1), alike AS (SELECT p, name, m AS sure FROM m QUALIFY row_number() OVER (PARTITION BY p ORDER BY m DESC, place) = 1),
grouped AS (SELECT p, name, sure FROM d, clu WHERE len(list_intersect(own, words))::DOUBLE / len(list_distinct(list_concat(own, words))) > 0.8 QUALIFY row_number() OVER (PARTITION BY p ORDER BY place) = 1),
answer AS (SELECT p, 'Answer: ' || own[-1] AS name, (length(p) * 7 % 10)::DOUBLE / 10 AS sure FROM d),
f AS (SELECT d.p AS product_type, CASE WHEN r.sure > 0.6 THEN {{'c': r.name, 's': r.sure, 'm': 'rule'}} WHEN g.name IS NOT NULL THEN {{'c': g.name, 's': g.sure, 'm': 'cluster'}} WHEN a.sure > 0.7 THEN {{'c': a.name, 's': a.sure, 'm': 'answer'}} WHEN k.sure > 0.6 THEN {{'c': k.name, 's': k.sure, 'm': 'similarity'}}
WHEN a.sure > 0.5 THEN {{'c': a.name, 's': a.sure, 'm': 'low_answer'}} WHEN r.sure > 0.3 THEN {{'c': r.name, 's': r.sure, 'm': 'low_rule'}} ELSE {{'c': array_to_string(list_transform(own, lambda w: upper(w[1]) || w[2:]), ' ') || ' Products', 's': 0.4::DOUBLE, 'm': 'generic'}} END AS f
FROM d JOIN rule r ON r.p = d.p JOIN alike k ON k.p = d.p JOIN answer a ON a.p = d.p LEFT JOIN grouped g ON g.p = d.p)"""


def recorded_answers(batch):
    """Stands for a remote model: the last word of a type, and a confidence by its length."""
    return batch.assign(category="Answer: " + batch["product_type"].str.split(" ").str[-1], confidence=batch["product_type"].str.len() * 7 % 10 / 10)


def _cascaded(spark, sf_dir):
    d = products(spark, sf_dir).select("product_type").distinct()
    answered = ask(d, FixedProvider("product_type string, category string, confidence double", recorded_answers)).filter("error IS NULL")
    words = F.split(F.lower("product_type"), " ")
    answer = F.struct("category", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    # each stage's result is a column of its own, as the cascade reads it several times
    staged = d.select("product_type", R.best_rule(F.col("product_type"), T.CASCADE).alias("rule"), R.cluster_match(words, T.CLUSTERS).alias("cluster"), R.similar_category(words, T.CASCADE).alias("similar"))
    found = R.cascade(F.col("rule"), F.col("cluster"), answer, F.col("similar"), F.concat(F.initcap("product_type"), F.lit(" Products")))
    return staged.join(answered, "product_type", "left").select("product_type", found.alias("f")).select("product_type", "f.*")


@query(f"WITH {_cascade_sql()} SELECT product_type, f.c AS category, round(f.s, 6) AS confidence, f.m AS method FROM f")
def category_cascade(spark, sf_dir):
    """Every type by the first stage that is sure enough: rules, clusters, recorded answers, likeness, a generic name."""
    return _cascaded(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_cascade_sql()} SELECT f.m AS method, count(*) AS n, round(CAST(sum(CAST(f.s AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean_confidence FROM f GROUP BY ALL")
def mapping_methods(spark, sf_dir):
    return _cascaded(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"), M.mean("confidence").alias("mean_confidence"))


@query(None)
def brand_origins(spark, sf_dir):
    brands = spark.createDataFrame(T.BRANDS, "brand string, origin string")
    d = products(spark, sf_dir).select("brand", "product_type").distinct().drop("origin")
    return R.origin_cascade(d, brands, hints="product_type", fuzzy=Config.of(spark).fuzzy_origin)


@query(None)
def private_brands(spark, sf_dir):
    d = products(spark, sf_dir).select("part", "brand", "product_type").distinct()
    sources = {"brand": F.array("brand"), "name": F.array("product_type"), "tokens": F.split("product_type", " ")}
    return R.private_cascade(d, "part", sources, [("brand#1", "house one"), ("large plate", "house plate"), ("gizmo", "house gizmo")], fuzzy=Config.of(spark).fuzzy_private)


DIRECT = {"red bolt": "Fasteners", "bolt": "Bolts", "gear": "Machines", "small": "Minor"}


@query("SELECT DISTINCT product_type, CASE product_type WHEN 'red bolt' THEN 'Fasteners' WHEN 'bolt' THEN 'Bolts' WHEN 'gear' THEN 'Machines' WHEN 'small' THEN 'Minor' ELSE CASE " + " ".join(f"WHEN contains(product_type, '{k}') OR contains('{k}', product_type) THEN '{v}'" for k, v in DIRECT.items()) + " ELSE 'Other Products' END END AS category FROM products")
def direct_partial_map(spark, sf_dir):
    d = products(spark, sf_dir).select("product_type").distinct()
    return d.select("product_type", R.partial_map(F.col("product_type"), DIRECT, F.lit("Other Products")).alias("category"))


@query(f"WITH d AS (SELECT DISTINCT product_type, category, CASE {_words(T.REPAIRS, 'lower(product_type)')} ELSE CASE WHEN contains(product_type, 'hot') THEN 'LARGE' END END AS p FROM products) SELECT product_type, CASE WHEN p IN (SELECT category FROM d) THEN p ELSE category END AS category FROM d")
def accepted_rules(spark, sf_dir):
    """Two tiers of rules whose result counts only if that category exists already."""
    d = products(spark, sf_dir).select("product_type", "category").distinct()
    proposed = F.coalesce(R.first_match(F.col("product_type"), T.REPAIRS), F.when(F.col("product_type").contains("hot"), "LARGE"))
    return R.accepted(d.withColumn("p", proposed), "category", "p").select("product_type", "category")


@query("WITH k(category, word) AS (VALUES " + ", ".join(f"('{r.category}', '{w}')" for r in T.CATALOG for w in r.words) + "), t AS (SELECT category, count(*) AS total FROM k GROUP BY 1), d AS (SELECT DISTINCT product_type FROM products), h AS (SELECT product_type, k.category, count(*) AS hits FROM d JOIN k ON contains(lower(product_type), word) GROUP BY ALL) SELECT product_type, h.category, hits, round(hits / total::DOUBLE, 6) AS share FROM h JOIN t ON h.category = t.category")
def keyword_theta_join(spark, sf_dir):
    words = spark.createDataFrame([(r.category, w) for r in T.CATALOG for w in r.words], "category string, word string")
    d = products(spark, sf_dir).select("product_type").distinct()
    return R.keyword_join(d, "product_type", F.col("product_type"), words)
