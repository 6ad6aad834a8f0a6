"""Queries of this subpackage over the pipeline's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, importance_resampling, minhash_dedup, packing, quality_votes, sentencepiece_scan, substring_dedup, token_counts, topk_search, toxicity_fm, vector_codes, warc_merkle, wavelet_store


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


DEDUP_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t
),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id = coalesce(root, s.doc_id) AS kept FROM s LEFT JOIN m ON node = s.doc_id
"""

_PIECES = ", ".join(f"CAST(sum(CAST('0x' || substring(sha, {1 + 8 * k}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))
AUDIT_SQL = f"""
WITH b AS (SELECT coalesce(page_id, -1) AS page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
r AS (
  SELECT page_id,
    concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
      'WARC-Target-URI: ', u, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(h), chr(13), chr(10), chr(13), chr(10),
      h, chr(13), chr(10), chr(13), chr(10)) AS record
  FROM b
),
s AS (SELECT page_id, strlen(record) AS length, sha256(record) AS sha FROM r),
g AS (
  SELECT page_id, CAST(floor(page_id // 1024) AS BIGINT) - CASE WHEN page_id < 0 AND page_id % 1024 <> 0 THEN 1 ELSE 0 END AS file, CAST(sum(length) AS BIGINT) AS length,
    CASE WHEN count(*) = 1 THEN min(sha) ELSE sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {_PIECES})) END AS sha256
  FROM s GROUP BY page_id
)
SELECT page_id, file,
  CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, sha256,
  CASE WHEN (page_id % 97 + 97) % 97 = 5 THEN 'missing' WHEN (page_id % 61 + 61) % 61 = 7 THEN 'changed' ELSE 'intact' END AS status
FROM g
"""

NON_SPACE = r"[^\x20\x09-\x0D]+"
BYTES_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"

QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{NON_SPACE}') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NON_SPACE}')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
m AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(m.n, 0) > 50 * len(w) AS base_failed
FROM t JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
"""

RESAMPLING_SQL = r"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM e)),
b AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(strlen(w) AS BIGINT)), lambda i: CAST('0x' || substring(hex(w), 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM v, tab),
s AS (SELECT k, count(*) AS n FROM d JOIN b USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM e JOIN b USING (w) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k)),
f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN b USING (w) JOIN g USING (k) GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, coalesce(weight, 0) AS weight FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= 10 * (SELECT count(*) FROM r WHERE n IS NOT NULL) // 100 THEN n END AS rank FROM r
"""

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM i),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM x JOIN f USING (k), (SELECT unnest(range(50)) AS j) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""


def _codes_sql(rounds: int = 6) -> str:
    """Rounds of assigning parts to entries and averaging them, one after the other."""
    nearest = "SELECT vec_id, p.k, min(list_sum(list_transform(range(1, len(p.y) + 1), lambda i: (p.y[i] - c.y[i]) * (p.y[i] - c.y[i]))) * 16 + e) AS m FROM p JOIN c{0} c ON c.k = p.k GROUP BY vec_id, p.k"
    averaged = "SELECT a.k, m % 16 AS e, j, CAST(floor(sum(y[j]) / count(*)) AS BIGINT) AS z FROM a{0} a JOIN p ON p.vec_id = a.vec_id AND p.k = a.k, (SELECT unnest(range(1, n + 1)) AS j FROM s) GROUP BY ALL"
    steps = "".join(
        f", a{r} AS MATERIALIZED ({nearest.format(r)}), u{r} AS MATERIALIZED ({averaged.format(r)}), c{r + 1} AS MATERIALIZED (SELECT k, e, coalesce(z, y) AS y FROM c{r} LEFT JOIN (SELECT k, e, list(z ORDER BY j) AS z FROM u{r} GROUP BY k, e) USING (k, e))"
        for r in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (SELECT max(len(x)) // 8 AS n FROM v),
p AS MATERIALIZED (SELECT vec_id, k, x[k * n + 1:k * n + n] AS y FROM v, s, (SELECT unnest(range(8)) AS k)),
c0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, y FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)){steps},
a AS MATERIALIZED ({nearest.format(rounds)}),
d AS (SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY k) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY k, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM d JOIN v USING (vec_id), h
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_documents(spark, sf_dir), percent=75)


def op2_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(_documents(spark, sf_dir))


def op3_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's ids of every text, and the text decoded from them; round_trip says whether it came back (marks in it count as spaces)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = sentencepiece_scan.encode_column(docs.withColumn("wanted", F.xxhash64(F.translate("text", "\u2581", " "))), path, keep=("doc_id", "wanted"))
    decoded = sentencepiece_scan.decode_column(encoded, path, keep=("doc_id", "wanted"))
    return decoded.select("doc_id", "n_pieces", "pieces_crc32", (F.xxhash64("text") == F.col("wanted")).alias("round_trip"))


def op4_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a replica in which some records were altered, and some lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page = F.coalesce("page_id", F.lit(-1))
    lost = pages.filter(F.pmod(page, F.lit(97)) != 5)
    replica = lost.withColumn("html", F.when(F.pmod(page, F.lit(61)) == 7, F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).otherwise(F.col("html")))
    return warc_merkle.audit(pages, replica)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_wavelet_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet_store.write_shards(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet_store.read_shards(shards)


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_votes.judge(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    machine = toxicity_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_fm.score(docs, machine)
    return scored.select("doc_id", toxicity_fm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def text_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    return op5_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    return op7_quality_votes(spark, sf_dir).drop("kept", "quality")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_context_tree_scores, op3_sentencepiece_scan, op4_warc_merkle_audit, op5_token_counts, op6_wavelet_token_store, op7_quality_votes, op8_topk_search, op9_toxicity_fm, op10_best_fit_packing, op11_importance_resampling, op12_substring_dedup, op13_vector_codes, text_byte_counts, quality_base_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": DEDUP_SQL, "op4_warc_merkle_audit": AUDIT_SQL, "op8_topk_search": TOP_K_SQL, "op11_importance_resampling": RESAMPLING_SQL, "op12_substring_dedup": REPEATS_SQL, "op13_vector_codes": _codes_sql(), "text_byte_counts": BYTES_SQL, "quality_base_counts": QUALITY_SQL}
