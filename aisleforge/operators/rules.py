"""Ordered rules and keyword tables: one engine, many tables.

Rule tables are written by people, so they are plan constants: a chain of CASE branches that
code generation handles without a join. Keyword dimensions that are tables of their own are joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import similar_names


@dataclass(frozen=True)
class Rule:
    """Texts that hold any of the words get the category; earlier rules win."""

    category: str
    words: tuple[str, ...]


def first_match(text: Column, rules: list[Rule]) -> Column:
    """The category of the first rule with a word inside the lower-cased text; null if there is none."""
    low, found = F.lower(text), None
    for rule in rules:
        hit = F.lit(False)
        for word in rule.words:
            hit = hit | low.contains(word)
        found = F.when(hit, rule.category) if found is None else found.when(hit, rule.category)
    return found if found is not None else F.lit(None).cast("string")


def repaired(df: DataFrame, category: str, rules: list[Rule], text: Column, open_values: tuple[str, ...] = ("Other Products", "unknown", "Unknown")) -> DataFrame:
    """Replaces only categories that are still open, and only by a match."""
    return df.withColumn(category, F.when(F.col(category).isin(*open_values), F.coalesce(first_match(text, rules), F.col(category))).otherwise(F.col(category)))


def mapped(c: Column, table: dict[str, str], rest: str) -> Column:
    """A lookup whose misses become `rest`; null stays null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(rest)))


def hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords the text holds."""
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in keywords), F.lit(0))


def catalog_match(text: Column, product_type: Column, catalog: list[Rule], least: float = 0.1) -> Column:
    """struct(category, confidence): hits plus 2 for the exact type, over the number of keywords, times 1.2 for several.

    The highest confidence wins, of equal ones the first in the catalogue; below `least` null and 0.
    """
    low, exact = F.lower(text), F.lower(product_type)
    scored = []
    for place, rule in enumerate(catalog):
        n = sum((F.when(low.contains(w), F.when(exact == w, 3).otherwise(1)).otherwise(0) for w in rule.words), F.lit(0))
        score = n / F.lit(float(len(rule.words)))
        scored.append(F.struct(F.when(n > 1, score * 1.2).otherwise(score).alias("confidence"), F.lit(-place).alias("place"), F.lit(rule.category).alias("category")))
    best = F.array_max(F.array(*scored))
    enough = best["confidence"] >= least
    return F.struct(F.when(enough, best["category"]).alias("category"), F.when(enough, best["confidence"]).otherwise(0.0).alias("confidence"))


def compact_match(text: Column, catalog: list[Rule], rest: str = "other", rest_confidence: float = 0.3) -> Column:
    """struct(category, confidence): min(2 hits / keywords, 1) of the best category; without a hit `rest`."""
    low = F.lower(text)
    scored = [F.struct(F.least(hits(low, r.words) * 2 / F.lit(float(len(r.words))), F.lit(1.0)).alias("confidence"), F.lit(-k).alias("place"), F.lit(r.category).alias("category")) for k, r in enumerate(catalog)]
    best = F.array_max(F.array(*scored))
    return F.struct(F.when(best["confidence"] > 0, best["category"]).otherwise(rest).alias("category"), F.when(best["confidence"] > 0, best["confidence"]).otherwise(rest_confidence).alias("confidence"))


def rule_score(text: Column, keywords: tuple[str, ...]) -> Column:
    """(sum of exact 1.0, prefix or suffix 0.8, inside 0.6, plus half the hits) over the number of keywords."""
    low = F.lower(text)
    parts = [F.when(low == w, 1.0).when(low.startswith(w) | low.endswith(w), 0.8).when(low.contains(w), 0.6).otherwise(0.0) for w in keywords]
    return (sum(parts, F.lit(0.0)) + hits(low, keywords) * 0.5) / float(len(keywords))


def best_rule(text: Column, catalog: list[Rule]) -> Column:
    """struct(confidence, category) of the best rule score, ties to the first rule."""
    best = F.array_max(F.array(*[F.struct(rule_score(text, r.words).alias("confidence"), F.lit(-k).alias("place"), F.lit(r.category).alias("category")) for k, r in enumerate(catalog)]))
    return F.struct(best["confidence"].alias("confidence"), best["category"].alias("category"))


def similar_category(words: Column, catalog: list[Rule]) -> Column:
    """struct(confidence, category): mean of the average and the largest share of a keyword's words found in the text."""
    scored = []
    for k, r in enumerate(catalog):
        shares = [F.size(F.array_intersect(words, F.array(*map(F.lit, w.split())))) / F.lit(float(len(w.split()))) for w in r.words]
        scored.append(F.struct(((sum(shares, F.lit(0.0)) / float(len(shares)) + F.greatest(*shares, F.lit(0.0))) / 2).alias("confidence"), F.lit(-k).alias("place"), F.lit(r.category).alias("category")))
    best = F.array_max(F.array(*scored))
    return F.struct(best["confidence"].alias("confidence"), best["category"].alias("category"))


def cluster_match(words: Column, clusters: list[tuple[str, float, tuple[str, ...]]], least: float = 0.8) -> Column:
    """struct(category, confidence) of the first cluster (name, confidence, types) with a type whose word Jaccard is over `least`, else null."""
    own = F.array_distinct(words)
    found = []
    for name, confidence, types in clusters:
        listed = [F.array(*map(F.lit, dict.fromkeys(t.lower().split()))) for t in types]
        near = [F.size(F.array_intersect(own, t)) / F.size(F.array_union(own, t)) > least for t in listed]
        found.append(F.when(reduce(or_, near), F.struct(F.lit(name).alias("category"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*found, F.lit(None).cast("struct<category:string,confidence:double>"))


def cascade(rule: Column, cluster: Column, answer: Column, similar: Column, generic: Column) -> Column:
    """struct(category, confidence, method) of the first stage that is sure enough.

    rule > 0.6, cluster, answer > 0.7, similar > 0.6, answer > 0.5, rule > 0.3, generic (0.4).
    """
    stage = lambda c, method: F.struct(c["category"].alias("category"), c["confidence"].alias("confidence"), F.lit(method).alias("method"))
    return F.coalesce(
        F.when(rule["confidence"] > 0.6, stage(rule, "rule")), F.when(cluster["category"].isNotNull(), stage(cluster, "cluster")), F.when(answer["confidence"] > 0.7, stage(answer, "answer")),
        F.when(similar["confidence"] > 0.6, stage(similar, "similarity")), F.when(answer["confidence"] > 0.5, stage(answer, "low_answer")), F.when(rule["confidence"] > 0.3, stage(rule, "low_rule")),
        F.struct(generic.alias("category"), F.lit(0.4).alias("confidence"), F.lit("generic").alias("method")),
    )


def category_role(facings: Column, headers: Column, promo: Column, endcap: Column, checkout: Column) -> Column:
    return F.when((facings > 50) & (headers > 0) & (promo < 0.2), "Destination").when((endcap > 0.2) | (checkout > 0.1) | (promo > 0.4), "Impulse").when((facings > 10) & (promo < 0.4), "Routine").otherwise("Unknown")


def share_role(share: Column) -> Column:
    return F.when(share >= 20, "Destination").when(share >= 10, "Core").when(share >= 5, "Complement").otherwise("Niche")


def share_role_with_brands(share: Column, brands: Column) -> Column:
    return F.when((share > 20) & (brands > 5), "Destination").when((share > 10) & (brands > 3), "Routine").when(brands > 2, "Convenience").otherwise("Niche")


def is_highlight(placement: Column, signage: Column, logo: Column, confidence: Column) -> Column:
    return (placement.isin("Endcap", "EyeLevel") | signage.isin("Promo", "Claim") | (logo >= 0.9)) & (confidence >= 0.75)


def store_zone(placement: Column, signage: Column) -> Column:
    return F.when(placement == "Endcap", "Endcap").when((placement == "Checkout") | (signage == "Price"), "Checkout").when(signage.isin("CategoryHeader", "Promo"), "Front").otherwise("Aisle")


def origin_cascade(df: DataFrame, brands: DataFrame, brand: str = "brand", hints: str | None = None, fuzzy: float = 0.8) -> DataFrame:
    """Adds origin, origin_confidence and origin_method: exact list, script, fuzzy list, keyword hints, unknown.

    Works on distinct brands; only those still open after the cheap stages meet the list (brand, origin), by `similar_names`, however
    long it is. Of a name's best ratios with local and other brands the higher one counts, of equal ones the other brands'.
    """
    from ..functions.text import THAI_RUN

    names = df.select(F.lower(F.trim(F.col(brand))).alias("name")).filter("name IS NOT NULL AND name NOT IN ('', 'unknown')").distinct()
    listed = brands.select(F.lower(F.trim("brand")).alias("name"), F.col("origin").alias("listed")).groupBy("name").agg(F.min_by("listed", F.when(F.col("listed") == "local", 0).otherwise(1)).alias("listed"))
    first = names.join(listed, "name", "left")
    share = (F.length("name") - F.length(F.regexp_replace("name", THAI_RUN, ""))) / F.length("name")
    exact = first.filter("listed IS NOT NULL").select("name", F.col("listed").alias("o"), F.lit(1.0).alias("c"), F.lit("exact_match").alias("m"))
    rest = first.filter("listed IS NULL")
    script = rest.filter(share > 0).select("name", F.lit("local").alias("o"), F.least(share * 1.5, F.lit(1.0)).alias("c"), F.lit("thai_script").alias("m"))
    open_names = rest.filter(share == 0).select("name")
    alike = similar_names(open_names, listed.select("name"), fuzzy).join(listed.select(F.col("name").alias("y"), "listed"), "y")
    rated = alike.groupBy(F.col("x").alias("name")).agg(*[F.coalesce(F.max(F.when((F.col("listed") == "local") == local, F.col("ratio"))), F.lit(0.0)).alias(c) for c, local in (("l", True), ("i", False))])
    near, far = F.col("l"), F.col("i")
    close = rated.select("name", F.when(near > far, "local").otherwise("international").alias("o"), F.greatest(near, far).alias("c"), F.lit("fuzzy_match").alias("m"))
    found = exact.unionByName(script).unionByName(close)
    joined = df.withColumn("__name", F.lower(F.trim(F.col(brand)))).join(found.withColumnRenamed("name", "__name"), "__name", "left")
    missing = F.col("__name").isNull() | F.col("__name").isin("", "unknown")
    guess = F.lit(None).cast("string")
    if hints:
        words = F.lower(F.coalesce(F.col(hints), F.lit("")))
        local, foreign = hits(words, LOCAL_HINTS), hits(words, FOREIGN_HINTS)
        guess = F.when(local > foreign, "local").when(foreign > local, "international")
    return joined.withColumns({
        "origin": F.when(missing, "unknown").otherwise(F.coalesce("o", guess, F.lit("unknown"))),
        "origin_confidence": F.when(missing, 0.0).otherwise(F.coalesce("c", F.when(guess.isNotNull(), 0.6), F.lit(0.0))),
        "origin_method": F.when(missing, "no_brand").otherwise(F.coalesce("m", F.when(guess.isNotNull(), "keyword_based"), F.lit("unknown"))),
    }).drop("__name", "o", "c", "m")


# fixed values: words that hint at an origin
LOCAL_HINTS = ("thailand", "thai", "bangkok", "siam", "local", "domestic")
FOREIGN_HINTS = ("imported", "europe", "america", "usa", "global", "international")


def private_cascade(df: DataFrame, key: str, sources: dict[str, Column], patterns: list[tuple[str, str]], fuzzy: float = 0.85) -> DataFrame:
    """key, private_brand, confidence, method, source of the rows that hold a private brand.

    sources: arrays of texts by name, in the order in which they are tried; patterns: (pattern, brand) in order. In each text
    an exact pattern (1.0) comes before one of six or more characters that makes up 70 % of a word (0.8), and that before a close one.
    """
    def labelled(name: str, c: Column) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(F.lit(name).alias("source"), F.lower(F.trim(t)).alias("text")))

    def fills_word(pattern: str) -> Column:
        return F.exists(F.split("text", r"\s+"), lambda w: w.contains(pattern) & (len(pattern) / F.length(w) >= 0.7))

    texts = F.concat(*[labelled(name, c) for name, c in sources.items()])
    exploded = df.select(key, F.posexplode(texts).alias("pos", "t")).select(key, "pos", "t.source", "t.text").filter("length(text) > 0")
    exact, inside = F.lit(None), F.lit(None)
    for order, (pattern, name) in reversed(list(enumerate(patterns))):
        found = F.struct(F.lit(order).alias("order"), F.lit(name).alias("name"))
        exact = F.when(F.col("text") == pattern, found).otherwise(exact)
        if len(pattern) >= 6:
            inside = F.when(F.col("text").contains(pattern) & fills_word(pattern), found).otherwise(inside)
    sure = exploded.withColumn("exact", exact).withColumn("inside", inside)
    known = sure.select(key, "pos", "source", "text", F.coalesce(F.when(F.col("exact").isNotNull(), F.struct(F.lit(1.0).alias("c"), F.lit("exact_match").alias("m"), F.col("exact.name").alias("b"))), F.when(F.col("inside").isNotNull(), F.struct(F.lit(0.8).alias("c"), F.lit("word_boundary_match").alias("m"), F.col("inside.name").alias("b")))).alias("hit"))
    open_texts = known.filter("hit IS NULL").select("text").distinct()
    tried = [(p, k, b) for k, (p, b) in enumerate(patterns) if len(p) >= 3]
    listed = df.sparkSession.createDataFrame(tried, "pattern string, k int, brand string")
    alike = similar_names(open_texts, listed.select("pattern"), fuzzy).join(listed, F.col("y") == F.col("pattern"))
    close = alike.groupBy(F.col("x").alias("text")).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "k", "ratio", "brand")).alias("x"))
    all_hits = known.join(close, "text", "left").withColumn("hit", F.coalesce("hit", F.when(F.col("x").isNotNull(), F.struct(F.col("x.ratio").alias("c"), F.lit("fuzzy_match").alias("m"), F.col("x.brand").alias("b"))))).filter("hit IS NOT NULL")
    return all_hits.groupBy(key).agg(F.min_by(F.struct("hit", "source"), "pos").alias("x")).select(key, F.col("x.hit.b").alias("private_brand"), F.col("x.hit.c").alias("confidence"), F.col("x.hit.m").alias("method"), F.col("x.source").alias("source"))


def partial_map(c: Column, table: dict[str, str], rest: Column) -> Column:
    """The table's value for the text itself, else of the first entry that holds it or is held by it, else `rest`."""
    low = F.lower(F.trim(c))
    found = F.coalesce(*[F.when(low == k, v) for k, v in table.items()])
    part = F.coalesce(*[F.when(low.contains(k) | ((F.length(low) > 0) & F.lit(k).contains(low)), v) for k, v in table.items()])
    return F.coalesce(found, part, rest)


def accepted(df: DataFrame, category: str, proposed: str) -> DataFrame:
    """Takes proposals only if the category already occurs in the data."""
    there = df.select(F.col(category).alias("__there")).filter("__there IS NOT NULL").distinct()
    joined = df.join(there, F.col(proposed) == F.col("__there"), "left")
    return joined.withColumn(category, F.coalesce("__there", category)).drop("__there")


def keyword_join(df: DataFrame, key: str, text: Column, keywords: DataFrame) -> DataFrame:
    """key, category, hits, share: how many of each category's keywords (category, word) the text holds.

    A containment test has no key to join on; the keyword table is a dimension that Spark broadcasts under its size limit.
    """
    totals = keywords.groupBy("category").agg(F.count("*").alias("total"))
    met = df.select(key, F.lower(text).alias("__text")).join(keywords, F.col("__text").contains(F.col("word")))
    counted = met.groupBy(key, "category").agg(F.count("*").alias("hits"))
    return counted.join(totals, "category").select(key, "category", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("share"))
