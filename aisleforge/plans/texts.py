"""Text, parsing, geometry, similarity and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions import parsing, scores, text
from ..operators import measures as M
from ..operators import similarity as S
from ..operators import vectors as V
from ..sources.tables import products, table
from .registry import query

CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
LABEL = "product_type || ' ' || size || CASE size % 8 WHEN 0 THEN 'ml' WHEN 1 THEN ' kg' WHEN 2 THEN ' l' WHEN 3 THEN ' oz' WHEN 4 THEN ' pack' WHEN 5 THEN ' baht' WHEN 6 THEN '% sale' ELSE ' aisle' END"


def _labels(spark, sf_dir):
    unit = F.lit(" aisle")
    for k, u in reversed(list(enumerate(("ml", " kg", " l", " oz", " pack", " baht", "% sale")))):
        unit = F.when(F.col("size") % 8 == k, u).otherwise(unit)
    return products(spark, sf_dir).select("part", F.concat("product_type", F.lit(" "), F.col("size").cast("string"), unit).alias("label")).distinct()


@query("SELECT doc_id, len(w) AS n, array_to_string(list_sort(list_distinct(w)), ' ') AS words FROM (SELECT doc_id, list_filter(" + WORDS.format(CLEAN) + ", lambda t: length(t) > 1) AS w FROM documents)", products=False)
def tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("words"))


def _sizes_sql() -> str:
    parts = []
    for unit, words in text.UNITS.items():
        plain = [w for w in words]
        parts.append(rf"list_transform(regexp_extract_all(label, '(?i)(\d+(?:[.,]\d+)?)\s?(?:{'|'.join(plain)})(?:[^A-Za-z]|$)', 1), lambda v: replace(v, ',', '.') || ' {unit}')")
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


@query(f"WITH l AS (SELECT DISTINCT part, {LABEL} AS label FROM products) SELECT part, array_to_string({_sizes_sql()}, ',') AS sizes FROM l")
def sizes(spark, sf_dir):
    return _labels(spark, sf_dir).select("part", F.array_join(text.sizes(F.col("label")), ",").alias("sizes"))


@query(f"""WITH l AS (SELECT DISTINCT part, size FROM products) SELECT part, CASE size % 8 WHEN 0 THEN size || 'ml' WHEN 1 THEN (size * 1000) || 'g' WHEN 2 THEN (size * 1000) || 'ml' WHEN 3 THEN size || 'oz' WHEN 4 THEN size || 'pack' END AS normalized FROM l""")
def normalized_sizes(spark, sf_dir):
    first = F.try_element_at(text.sizes(F.col("label")), F.lit(1))
    return _labels(spark, sf_dir).select("part", F.when(first.isNotNull(), text.normalized_size(first)).alias("normalized"))


@query(f"""WITH l AS (SELECT DISTINCT part, size, {LABEL} AS label FROM products)
SELECT part, CASE WHEN size % 8 <= 4 THEN 'size' WHEN size % 8 = 6 THEN 'promotion' WHEN len(string_split(label, ' ')) <= 3 AND regexp_matches(label, '[A-Z]') THEN 'category' ELSE 'product' END AS kind FROM l""")
def text_type(spark, sf_dir):
    return _labels(spark, sf_dir).select("part", text.text_type(F.col("label")).alias("kind"))


@query("WITH l AS (SELECT DISTINCT part, size, product_type FROM products) SELECT part, CASE WHEN size % 8 = 5 THEN 'price' WHEN size % 8 <= 3 THEN 'size' ELSE 'general' END AS kind FROM l")
def crop_text_type(spark, sf_dir):
    return _labels(spark, sf_dir).select("part", text.crop_text_type(F.col("label")).alias("kind"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 1)) AS english, len(regexp_extract_all(text, '[\x{0E00}-\x{0E7F}]+')) AS thai FROM documents", products=False)
def script_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.scripts(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s.english").cast("long").alias("english"), F.size("s.thai").cast("long").alias("thai"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(replace(text, ' ', '-' || chr(10)), '-\s*\n\s*', '', 'g')) AS joined FROM conversations", products=False)
def dehyphenate(spark, sf_dir):
    broken = F.replace(F.col("text"), F.lit(" "), F.lit("-\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.dehyphenate(broken)).alias("joined"))


@query(rf"SELECT doc_id, array_to_string(list_filter(string_split({CLEAN}, ' '), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^\d+$') AND regexp_matches(w, '\p{{Lu}}')), ' ') AS candidates FROM documents", products=False)
def brand_candidates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.brand_candidates(F.col("text")), " ").alias("candidates"))


@query(rf"""WITH l AS (SELECT DISTINCT part, lower({LABEL}) AS label FROM products), c AS (SELECT part, regexp_replace(regexp_replace(regexp_replace(label, '(?:฿|บาท|baht|thb|\$)\s*\d+|\d+(?:[.,]\d+)?\s*(?:฿|บาท|baht|thb|\$)', ' ', 'g'), '\d+(?:[.,]\d+)?\s?(?:ml|l|g|kg|oz)\b', ' ', 'g'), '\d+', ' ', 'g') AS label FROM l)
SELECT part, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(label, '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2))), ' ') AS words FROM c""")
def ocr_tokens(spark, sf_dir):
    return _labels(spark, sf_dir).select("part", F.array_join(F.array_sort(text.ocr_tokens(F.col("label"))), " ").alias("words"))


@query("SELECT DISTINCT product_type, substring(replace(replace(replace(lower(category || ' & ' || product_type), ' & ', '_'), ' ', '_'), 'products', ''), 1, 20) AS slug, CASE WHEN length(category || product_type) > 15 THEN substring(category || product_type, 1, 12) || '...' ELSE category || product_type END AS short, regexp_replace(product_type, '[^\\w\\-.]', '_', 'g') AS file FROM products")
def names(spark, sf_dir):
    p = products(spark, sf_dir).select("product_type", "category").distinct()
    return p.select("product_type", text.slug(F.concat_ws(" & ", "category", "product_type")).alias("slug"), text.shortened(F.concat("category", "product_type")).alias("short"), text.file_name(F.col("product_type")).alias("file")).distinct()


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'this', 'that', 'was', 'are', 'not', 'but', 'all'))) AS n FROM documents", products=False)
def preprocessed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.preprocessed(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, md5(trim(nfc_normalize(coalesce(text, '') || 'e' || chr(769)), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(133) || chr(160))) AS nfc FROM documents", products=False)
def nfc_normalize(spark, sf_dir):
    """Composed texts; a decomposed letter at the end shows that they are."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.nfc(F.concat(F.coalesce("text", F.lit("")), F.lit("e\u0301")))).alias("nfc"))


@query(None)
def nfkd_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.nfkd(F.col("text"))).alias("nfkd"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type || '-' || json_extract_string(props, '$.k') AS brand, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), 0.5) AS confidence FROM events""", products=False)
def llm_json_parse(spark, sf_dir):
    """Objects and arrays of products inside free text, with defaults for missing fields."""
    e = table(spark, sf_dir, "events")
    answer = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```\nBye"))
    array = F.concat(F.lit('Sure: [{"brand": "'), "event_type", F.lit("-"), F.get_json_object("props", "$.k"), F.lit('", "type": "x"}] done'))
    parsed = e.select("event_id", F.from_json(parsing.json_object(answer), "k int").alias("o"), F.inline(parsing.products_of(array)))
    return parsed.select("event_id", F.col("o.k").alias("k"), "brand", "confidence")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'local' WHEN 'click' THEN 'international' ELSE 'unknown' END AS origin, CASE event_type WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM events""", products=False)
def origin_answers(spark, sf_dir):
    answer = F.when(F.col("event_type") == "view", "local|0.9|made nearby").when(F.col("event_type") == "click", "This looks International to me").otherwise("no idea")
    return table(spark, sf_dir, "events").select("event_id", parsing.origin_answer(answer).alias("a")).select("event_id", "a.origin", "a.confidence")


@query("""WITH p AS (SELECT DISTINCT part, (part % 5 + 1) * 320 AS w, (part % 3 + 1) * 240 AS h FROM products), r AS (SELECT unnest(range(8)) AS r), c AS (SELECT unnest(range(8)) AS c)
SELECT part, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(floor(c * (w / 8.0::DOUBLE) * (1 - 0.3::DOUBLE)) AS INTEGER) AS x, CAST(floor(r * (h / 8.0::DOUBLE) * (1 - 0.3::DOUBLE)) AS INTEGER) AS y, CAST(floor(w / 8.0) AS INTEGER) AS width, CAST(floor(h / 8.0) AS INTEGER) AS height FROM p, r, c""")
def crop_grid(spark, sf_dir):
    p = products(spark, sf_dir).select("part").distinct().select("part", ((F.col("part") % 5 + 1) * 320).alias("w"), ((F.col("part") % 3 + 1) * 240).alias("h"))
    return p.select("part", F.inline(scores.grid_crops(F.col("w"), F.col("h"))))


SET_SQL = "s AS (SELECT doc_id AS id, list_distinct(list_filter(" + WORDS.format(CLEAN) + ", lambda t: length(t) > 1)) AS t FROM documents)"
JACCARD = "len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE"


def _sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(text.tokens(F.col("text"))).alias("tokens"))


@query(f"WITH {SET_SQL} SELECT a.id AS a, b.id AS b, round({JACCARD}, 6) AS jaccard FROM s a JOIN s b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND {JACCARD} >= 0.8", products=False)
def jaccard_pairs(spark, sf_dir):
    return S.jaccard_pairs(_sets(spark, sf_dir), "id", "tokens", 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3", products=False)
def cosine_pairs(spark, sf_dir):
    return S.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.3).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3", products=False)
def cosine_matrix(spark, sf_dir):
    """The similarity matrix of all vectors, as far as it reaches 0.3."""
    return V.cosine_join(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3).select("a", "b", F.round("cosine", 4).alias("cosine"))


HASH = "substring(md5(CAST(conv_id % 40 AS VARCHAR)), 1, 12) || substring(md5(CAST(conv_id AS VARCHAR) || '/' || turn), 1, 4)"


def _hashes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.substring(F.md5((F.col("conv_id") % 40).cast("string")), 1, 12), F.substring(F.md5(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))), 1, 4)).alias("phash"), text.tokens(F.col("text")).alias("tokens"))


@query(f"WITH h AS (SELECT conv_id * 100 + turn AS id, {HASH} AS h FROM conversations) SELECT a.id AS a, b.id AS b, CAST(hamming(a.h, b.h) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id AND hamming(a.h, b.h) <= 3", products=False)
def hamming_pairs(spark, sf_dir):
    return S.hamming_pairs(_hashes(spark, sf_dir), "id", "phash", 3)


COMPONENTS = f"""WITH RECURSIVE {SET_SQL}, e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id <> b.id AND len(a.t) > 0 AND len(b.t) > 0 AND {JACCARD} >= 0.8), r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


def _duplicate_roots(spark, sf_dir):
    return S.jaccard_components(_sets(spark, sf_dir), "id", "tokens", 0.8)


@query(COMPONENTS + " SELECT node, root FROM c", products=False)
def dup_components(spark, sf_dir):
    return _duplicate_roots(spark, sf_dir)


CANONICAL = COMPONENTS + ", m AS (SELECT doc_id, n_chars, coalesce(root, doc_id) AS g, root FROM documents LEFT JOIN c ON node = doc_id), k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY g ORDER BY n_chars DESC, doc_id) AS canonical_id FROM m)"


def _canonical(spark, sf_dir):
    return S.canonical_rows(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id", _duplicate_roots(spark, sf_dir), [F.desc("n_chars")])


@query(CANONICAL + " SELECT doc_id, canonical_id, root IS NOT NULL AND canonical_id <> doc_id AS is_duplicate FROM k", products=False)
def canonical_rows(spark, sf_dir):
    return _canonical(spark, sf_dir).select("doc_id", "canonical_id", "is_duplicate")


@query(CANONICAL + ", z AS (SELECT canonical_id, count(*) AS n FROM k GROUP BY canonical_id) SELECT n AS duplicate_count, count(*) AS items FROM z GROUP BY n", products=False)
def dup_stats(spark, sf_dir):
    return _canonical(spark, sf_dir).groupBy("canonical_id").agg(F.count("*").alias("n")).groupBy(F.col("n").alias("duplicate_count")).agg(F.count("*").alias("items"))


TOKENS = "list_distinct(list_filter(" + WORDS.format(CLEAN) + ", lambda t: length(t) > 1))"
HEX = "'0123456789abcdef'"
VECTOR = f"list_transform(range(0, 48), lambda i: CAST((instr({HEX}, substring(h, CAST(2 * i + 1 AS BIGINT), 1)) - 1) * 16 + instr({HEX}, substring(h, CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS DOUBLE))"
EMBEDDED = f"d AS (SELECT doc_id AS id, source, lang, {TOKENS} AS t, md5(text || '_0') || md5(text || '_1') || md5(text || '_2') AS h FROM documents), v AS (SELECT *, {VECTOR} AS e FROM d)"
SAME_WORDS = f"CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN {JACCARD} ELSE 0 END"
ROOTS = "r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"
ALIKE = f"(0.4::DOUBLE * list_cosine_similarity(a.e, b.e) + 0.3::DOUBLE * {SAME_WORDS} + 0.3::DOUBLE) * 0.95::DOUBLE"
PRODUCTS = f"WITH RECURSIVE {EMBEDDED}, l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.source = b.source AND a.lang = b.lang AND a.id <> b.id AND 1 - {ALIKE} <= 0.15), {ROOTS}"


def _shelf_products(spark, sf_dir):
    """Texts as products: the source as brand, the language as type, each on an image of its own."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("brand"), F.col("lang").alias("type"), F.col("doc_id").cast("string").alias("image"), F.lit(0.95).alias("confidence"), F.array_distinct(text.tokens(F.col("text"))).alias("tokens"), scores.hash_embedding(F.col("text")).alias("embedding"))


@query(PRODUCTS + " SELECT node, root FROM c", products=False)
def product_duplicates(spark, sf_dir):
    """Products of one brand and type on different images, by hash embeddings and tokens."""
    return S.duplicate_products(_shelf_products(spark, sf_dir))


@query(PRODUCTS + f""", m AS (SELECT v.*, c.root, 0.4::DOUBLE * 0.95 + 0.3::DOUBLE * least(len(t) / 10.0, 1) + CASE WHEN source IS NOT NULL AND lower(source) NOT IN ('', 'unknown') THEN 0.2 ELSE 0 END + 0.1 AS s FROM v LEFT JOIN c ON node = id),
k AS (SELECT *, first_value(id) OVER (PARTITION BY coalesce(root, id) ORDER BY round(s, 9) DESC, id) AS best, count(*) OVER (PARTITION BY coalesce(root, id)) AS n FROM m), g AS (SELECT coalesce(root, id) AS g, array_to_string(list_sort(list(CAST(id AS VARCHAR))), ',') AS images FROM m GROUP BY ALL)
SELECT a.id, a.root AS cluster_id, a.best AS canonical_id, a.best = a.id AS is_canonical, CASE WHEN a.best = a.id THEN a.n END AS duplicate_count, CASE WHEN a.best = a.id THEN images END AS source_images, CASE WHEN a.best <> a.id THEN 'cross_image_duplicate' END AS reason, CASE WHEN a.best <> a.id THEN round({ALIKE}, 4) END AS similarity
FROM k a JOIN g ON g = coalesce(a.root, a.id) JOIN v b ON b.id = a.best""", products=False)
def canonical_products(spark, sf_dir):
    found = S.canonical_products(_shelf_products(spark, sf_dir))
    return found.withColumns({"source_images": F.array_join("source_images", ","), "similarity": F.round("similarity", 4)})


@query(f"WITH RECURSIVE {EMBEDDED}, w AS (SELECT *, len(t) AS n FROM v), h AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id < b.id AND 2 * a.n >= b.n AND 2 * b.n >= a.n AND 1 - (0.6::DOUBLE * list_cosine_similarity(a.e, b.e) + 0.4::DOUBLE * CASE WHEN len(a.t) = 0 AND len(b.t) = 0 THEN 1 ELSE {SAME_WORDS} END) <= 0.2), l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h), {ROOTS} SELECT node, root FROM c", products=False)
def image_clusters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(text.tokens(F.col("text"))).alias("tokens"), scores.hash_embedding(F.col("text")).alias("embedding"))
    return S.image_clusters(d)


@query(None)
def brand_consolidation(spark, sf_dir):
    return S.leader_clusters(products(spark, sf_dir).withColumn("brand", F.concat_ws(" ", "brand", "product_type")), Config.of(spark).brand_merge_ratio)


@query(None)
def tfidf_kmeans(spark, sf_dir):
    """Clusters of product types with names from their heaviest terms."""
    from ..operators.topics import cluster_names, tfidf_clusters

    kinds = products(spark, sf_dir).select("product_type").distinct()
    clustered, vocabulary = tfidf_clusters(kinds, "product_type", 6)
    return clustered.select("product_type", "cluster").join(cluster_names(clustered, vocabulary), "cluster")


@query(None)
def category_clusters(spark, sf_dir):
    """Discovered categories of product types: k-means of many sizes and density clusters, the largest of each name."""
    from ..operators.topics import cluster_names, merged_names, pooled_clusters

    found, vocabulary = pooled_clusters(products(spark, sf_dir).select("product_type").distinct(), "product_type")
    by = ["run", "cluster"]
    sized = found.groupBy(*by).agg(F.count("*").alias("n"), F.first("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("product_type")), ", ").alias("product_types"))
    return merged_names(sized.join(cluster_names(found, vocabulary, by=by), by), by)


@query(None)
def cluster_coherence(spark, sf_dir):
    """Clusters of the products without a category, by type and brand, with the share of their most frequent type."""
    from ..operators.topics import coherent_clusters

    rest = products(spark, sf_dir).filter("category = 'Other Products'").select("product_type", F.lower(F.concat_ws(" ", "product_type", "brand")).alias("description"))
    found = coherent_clusters(rest, "product_type", "description")
    return found.select("cluster", "size", F.array_join("top_types", ", ").alias("top_types"), F.round("coherence", 6).alias("coherence"))


@query("""WITH o AS (SELECT l_orderkey AS image_id, p_name AS object, l_discount AS score, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey), p AS (SELECT DISTINCT o_orderkey AS image_id, o_orderkey AS product, 'gear' AS w FROM orders),
r AS (SELECT product, object, score, row_number() OVER (PARTITION BY product ORDER BY contains(object, w) DESC, score DESC, object) AS k FROM p JOIN o ON p.image_id = o.image_id) SELECT product, object, score FROM r WHERE k = 1""", products=False)
def object_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    objects = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("image_id"), F.col("p_name").alias("object"), F.col("l_discount").alias("score"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("product"), F.array(F.lit("gear")).alias("keywords"))
    return S.best_object(wanted, objects).select("product", "object", "score")


@query("SELECT supermarket, category, round(CAST(sum(CAST(0.4 * confidence + 0.3 * least(line / 10.0, 1.0) + CASE WHEN brand IS NOT NULL AND brand <> 'unknown' THEN 0.2 ELSE 0.0 END + 0.1 AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS mean_score FROM products GROUP BY ALL")
def canonical_scores(spark, sf_dir):
    score = scores.canonical_score(F.col("confidence"), F.col("line"), F.coalesce(F.col("brand") != "unknown", F.lit(False)), F.lit(True))
    return products(spark, sf_dir).groupBy("supermarket", "category").agg(M.mean(score, 4).alias("mean_score"))


@query(r"""WITH w AS (SELECT l_orderkey AS image_id, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+')) AS w FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT image_id, array_to_string(list_sort(list(DISTINCT w)), ' ') AS tokens FROM w GROUP BY image_id""", products=False)
def annotation_tokens(spark, sf_dir):
    """Distinct words of the annotations of an image."""
    held = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(F.struct(F.col("p_name").alias("name"))).alias("texts"))
    return held.select("image_id", F.array_join(F.array_sort(text.annotation_tokens(F.col("texts"))), " ").alias("tokens"))


@query("SELECT doc_id, md5(trim(replace(lower(' ' || lang || 'กั' || text), 'ั', ''))) AS digest FROM documents", products=False)
def normalized_thai(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.normalized_thai(F.concat(F.lit(" "), "lang", F.lit("กั"), "text"))).alias("digest"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: 0.7::DOUBLE * x[i] + 0.3::DOUBLE * x[len(x) + 1 - i]) AS y FROM e)
SELECT vec_id, round(y[1] / sqrt(list_dot_product(y, y)), 6) AS first, round(y[len(y)] / sqrt(list_dot_product(y, y)), 6) AS last FROM f""", products=False)
def fused_embeddings(spark, sf_dir):
    """Vectors fused with their mirror images, of length 1."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fused = table(spark, sf_dir, "embeddings").select("vec_id", scores.fused_embedding(x, F.reverse(x)).alias("y"))
    return fused.select("vec_id", F.round(F.col("y")[0], 6).alias("first"), F.round(F.element_at("y", -1), 6).alias("last"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * l_quantity * 3) AS INTEGER) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s >= 3600 THEN printf('%dh %02dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM s""", products=False)
def durations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.duration(F.col("l_quantity") * F.col("l_quantity") * 3).alias("took"))
