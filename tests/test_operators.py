"""Operators against brute force, and rules on cases."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aisleforge.operators import measures as M
from aisleforge.operators import relations as J
from aisleforge.operators import rules as R
from aisleforge.operators import similarity as S
from aisleforge.operators.components import connected_components


def brute_jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_jaccard_pairs_lose_none(spark, least):
    rng = random.Random(1)
    sets = {k: {rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))} for k in range(80)}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id int, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and brute_jaccard(sets[a], sets[b]) >= least}
    assert {(r.a, r.b) for r in S.jaccard_pairs(df, "id", "tokens", least).collect()} == want


def test_hamming_pairs_lose_none(spark):
    rng = random.Random(2)
    hashes = {k: "".join(rng.choice("01") for _ in range(16)) for k in range(60)}
    df = spark.createDataFrame(list(hashes.items()), "id int, h string")
    far = lambda a, b: sum(x != y for x, y in zip(hashes[a], hashes[b], strict=True))
    want = {(a, b, far(a, b)) for a in hashes for b in hashes if a < b and far(a, b) <= 5}
    assert {tuple(r) for r in S.hamming_pairs(df, "id", "h", 5).collect()} == want


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=20))
@settings(max_examples=6, deadline=None)
def test_components_are_the_transitive_closure(links):
    found = {r.node: r.root for r in connected_components(SparkSession.getActiveSession().createDataFrame(links, "a long, b long")).collect()}
    groups = {n: {n} for pair in links for n in pair}
    for _ in range(len(groups)):
        for a, b in links:
            both = groups[a] | groups[b]
            for n in both:
                groups[n] = both
    assert found == {n: min(g) for n, g in groups.items()}


def test_canonical_rows(spark):
    items = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0), (4, 1.0)], "id long, q double")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, root long")
    found = {r.id: (r.canonical_id, r.is_duplicate) for r in S.canonical_rows(items, "id", roots, [F.desc("q")]).collect()}
    assert found == {1: (2, True), 2: (2, False), 3: (2, True), 4: (4, False)}
    written = {r.id: r.is_duplicate for r in S.canonical_rows(items, "id", roots, [F.desc("q")], as_written=True).collect()}
    assert written == {1: True, 2: True, 3: True, 4: False}


def test_duplicate_products_at_the_border(spark):
    rows = [(k, "Nova", "tea", f"img{k}", c, ["green", "tea"], [1.0, 0.0]) for k, c in ((1, 0.9), (2, 0.9), (3, 0.5))] + [(4, "Nova", "milk", "img4", 0.9, ["green", "tea"], [1.0, 0.0]), (5, "NOVA", "Tea", "img1", 0.9, ["green", "tea"], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, brand string, type string, image string, confidence double, tokens array<string>, embedding array<double>")
    found = {r.node: r.root for r in S.duplicate_products(df).collect()}
    assert found == {1: 1, 2: 1, 5: 1}  # 5 is not linked to 1 on the same image, but through 2


def test_image_clusters_collapse_copies(spark):
    rows = [(i, ["a", "b"], [1.0, 0.0]) for i in range(300)] + [(300, ["a", "b"], [0.9, 0.1]), (301, [], [1.0, 0.0]), (302, [], [1.0, 0.0]), (303, [], [0.0, 0.0]), (304, [], [0.0, 0.0]), (305, ["z"], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, embedding array<double>")
    found = {r.node: r.root for r in S.image_clusters(df).collect()}
    assert found == {i: 0 for i in range(301)} | {301: 301, 302: 301}


def test_image_clusters_drop_lone_images(spark):
    rows = [(1, ["a", "b"], [1.0, 0.0]), (2, ["a", "b"], [1.0, 0.1]), (3, [], [0.0, 1.0]), (4, [], [0.0, 1.0]), (5, ["z"], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, embedding array<double>")
    assert {r.node: r.root for r in S.image_clusters(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_tiers(spark):
    df = spark.createDataFrame([("a", y) for y in (0.1, 0.15, 0.5, 0.8, 0.85)] + [("b", 0.1), ("b", 0.9)], "g string, y double")
    found = sorted((r.g, r.y, r.tier) for r in S.tiers(df, ["g"], "y").collect())
    assert found == [("a", 0.1, 1), ("a", 0.15, 1), ("a", 0.5, 1), ("a", 0.8, 2), ("a", 0.85, 2), ("b", 0.1, 1), ("b", 0.9, 1)]


def test_hhi_bounds_and_nulls(spark):
    df = spark.createDataFrame([("s", b) for b in ["a", "a", "b", None]], "store string, brand string")
    assert M.hhi(df, "brand", ["store"]).first().hhi == 0.3125
    assert M.hhi(df, "brand", ["store"], known_only=True).first().hhi == pytest.approx(0.555556)


def test_buckets_partition_the_keys(spark):
    counts = {"a": 1, "b": 2, "c": 4, "d": 5, "e": 9, "f": 10, "g": 19, "h": 20}
    df = spark.createDataFrame([("s", k) for k, n in counts.items() for _ in range(n)], "s string, k string")
    edges = [("1", 1, 1), ("2-4", 2, 4), ("5-9", 5, 9), ("10-19", 10, 19), ("20+", 20, None)]
    assert {r.bucket: r["keys"] for r in M.size_buckets(df, "k", ["s"], edges).collect()} == {"1": 1, "2-4": 2, "5-9": 2, "10-19": 2, "20+": 1}


def test_top_n_others_without_rest(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert [tuple(r) for r in M.top_n_others(df, "k", 2).orderBy("k").collect()] == [("a", 2), ("b", 1)]


def test_histogram_of_equal_values(spark):
    assert [tuple(r) for r in M.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 20).collect()] == [(1, 2)]
    assert M.histogram(spark.createDataFrame([], "v double"), "v", 20).count() == 0


def test_lookup_takes_the_last_pair(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, c string")
    pairs = spark.createDataFrame([("a", "first", 1), ("a", "last", 2)], "k string, v string, seq int")
    assert {r.k: r.c for r in J.lookup_last(df, pairs, "k", "v", "seq", "c").collect()} == {"a": "last", "b": "y"}


def test_overlap_counts_null_as_a_member(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["p", None, "p"], [None, "q", "r"]))
    found = J.set_sizes(a, b, "k").first()
    assert (found.size_a, found.size_b, found.shared, found.only_a, found.only_b, found.overlap_pct) == (2, 3, 1, 1, 2, 50.0)


RULES = [R.Rule("Tea", ("tea", "chai")), R.Rule("Drinks", ("tea", "milk", "juice", "water"))]


def test_first_rule_wins_and_only_open_rows_change(spark):
    df = spark.createDataFrame([("Green TEA", "Other Products"), ("milk", "Other Products"), ("soap", "Other Products"), ("tea", "Set")], "t string, c string")
    assert [r.c for r in R.repaired(df, "c", RULES, F.col("t")).collect()] == ["Tea", "Drinks", "Other Products", "Set"]


def test_catalog_matches(spark):
    df = spark.createDataFrame([("tea",), ("green tea",), ("soap",)], "t string")
    found = [(r.m.category, round(r.m.confidence, 3)) for r in df.select(R.catalog_match(F.col("t"), F.col("t"), RULES).alias("m")).collect()]
    assert found == [("Tea", 1.8), ("Tea", 0.5), (None, 0.0)]
    compact = [(r.m.category, r.m.confidence) for r in df.select(R.compact_match(F.col("t"), RULES).alias("m")).collect()]
    assert compact == [("Tea", 1.0), ("Tea", 1.0), ("other", 0.3)]


def test_cascade_order(spark):
    s = lambda c, x: F.struct(F.lit(c).cast("string").alias("category"), F.lit(x).alias("confidence"))
    none = s(None, 0.0)
    row = spark.range(1).select(
        R.cascade(s("r", 0.7), s("c", 0.9), none, none, F.lit("g")).alias("a"), R.cascade(s("r", 0.4), s("c", 0.9), s("l", 0.9), none, F.lit("g")).alias("b"), R.cascade(s("r", 0.4), none, s("l", 0.6), s("s", 0.7), F.lit("g")).alias("c"),
        R.cascade(s("r", 0.4), none, s("l", 0.6), none, F.lit("g")).alias("d"), R.cascade(s("r", 0.4), none, none, none, F.lit("g")).alias("e"), R.cascade(none, none, none, none, F.lit("g")).alias("f"),
    ).first()
    assert [x.method for x in row] == ["rule", "cluster", "similarity", "low_answer", "low_rule", "generic"]


def test_cluster_match(spark):
    df = spark.createDataFrame([(["iced", "tea"],), (["tea", "tea", "green"],), (["soap"],), ([],), (None,)], "w array<string>")
    clusters = [("Teas", 0.7, ("green tea", "tea iced")), ("All", 0.8, ("iced tea", "soap"))]
    assert [r.c and tuple(r.c) for r in df.select(R.cluster_match(F.col("w"), clusters).alias("c")).collect()] == [("Teas", 0.7), ("Teas", 0.7), ("All", 0.8), None, None]
    assert df.select(R.cluster_match(F.col("w"), []).alias("c")).filter("c IS NOT NULL").count() == 0


def test_origin_cascade(spark):
    brands = spark.createDataFrame([("Siam Gold", "local"), ("Northstar", "international")], "brand string, origin string")
    df = spark.createDataFrame([("siam gold ", ""), ("ข้าวหอม", ""), ("Northstor", ""), ("Zzz", "imported from europe"), ("Qqq", "plain"), ("unknown", "thai"), (None, "")], "brand string, words string")
    found = {r.brand: (r.origin, r.origin_method) for r in R.origin_cascade(df, brands, hints="words").collect()}
    assert found == {"siam gold ": ("local", "exact_match"), "ข้าวหอม": ("local", "thai_script"), "Northstor": ("international", "fuzzy_match"), "Zzz": ("international", "keyword_based"), "Qqq": ("unknown", "unknown"), "unknown": ("unknown", "no_brand"), None: ("unknown", "no_brand")}


def test_private_cascade(spark):
    rows = [(1, "Oak", "x", []), (2, "Acme", "long-garden", []), (3, "Acme", "soap", ["garden1"]), (4, "Acme", "gardem", []), (5, "Soakbright", "soap", ["a"])]
    df = spark.createDataFrame(rows, "id int, brand string, name string, tokens array<string>")
    found = {r.id: (r.private_brand, r.method, r.source) for r in R.private_cascade(df, "id", {"brand": F.array("brand"), "name": F.array("name"), "tokens": F.col("tokens")}, [("oak", "OAK"), ("garden", "GARDEN")], fuzzy=0.83).collect()}
    assert found == {1: ("OAK", "exact_match", "brand"), 3: ("GARDEN", "word_boundary_match", "tokens"), 4: ("GARDEN", "fuzzy_match", "name")}


def test_topics(spark):
    from aisleforge.operators.topics import cluster_names, merged_names, tfidf_clusters

    df = spark.createDataFrame([(t,) for t in ["green tea", "black tea", "iced tea", "hand soap", "dish soap", "bar soap"] * 2], "t string")
    clustered, words = tfidf_clusters(df, "t", 2, bigrams=False)
    groups = Counter((r.t.split()[1], r.cluster) for r in clustered.collect())
    assert len(groups) >= 2
    names = cluster_names(clustered, words)
    assert names.count() == 2
    same = spark.createDataFrame([(0, 3, "Tea Soap"), (1, 5, "soap tea"), (2, 5, "Tea soap"), (3, 1, "Soap")], "cluster int, n int, name string")
    assert {r.cluster for r in merged_names(same).collect()} == {1, 3}
    # five of six words and nine of eleven are over 0.8; a name that went does not take others with it
    long = [(4, 9, "a b c d e f g h i j"), (5, 8, "a b c d e f g h i k"), (6, 7, "a b c d e f g h k l"), (7, 3, "p q r s t u"), (8, 2, "p q r s t")]
    assert {r.cluster for r in merged_names(spark.createDataFrame(long, same.schema)).collect()} == {4, 6, 7}
    assert isinstance(clustered.toPandas(), pd.DataFrame)


def brute_dbscan(points, eps, least):
    unit = {k: v / np.linalg.norm(v) for k, v in points.items() if np.linalg.norm(v) > 0}
    near = {k: {j for j, w in unit.items() if v @ w >= 1 - eps - 1e-9} for k, v in unit.items()}
    core = {k for k in near if len(near[k]) >= least}
    root = {k: k for k in core}
    for _ in unit:
        root = {k: min(root[j] for j in near[k] & core) for k in core}
    return {k: min(root[j] for j in near[k] & core) for k in near if near[k] & core}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_density_clusters(spark, seed):
    from pyspark.ml.linalg import Vectors

    from aisleforge.operators.topics import dbscan

    rnd = np.random.default_rng(seed)
    points = {i: np.where(rnd.random(12) < 0.3, rnd.integers(1, 4, 12), 0).astype(float) for i in range(60)}
    points |= {60: points[3], 61: points[3], 62: points[3] * 2, 63: np.zeros(12)}
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in points.items()], ["id", "features"])
    for eps, least in ((0.5, 3), (0.15, 3), (0.3, 5)):
        found = {r.id: r.cluster for r in dbscan(df, "id", eps=eps, min_samples=least).collect()}
        assert found == brute_dbscan(points, eps, least)


def test_pooled_and_coherent_clusters(spark):
    from aisleforge.operators.topics import coherent_clusters, pooled_clusters

    df = spark.createDataFrame([(f"{a} {b}",) for a in ("green", "black", "iced", "herbal") for b in ("tea", "soap", "rice")], "t string")
    found, _ = pooled_clusters(df, "t")
    sizes = Counter((r.run, r.cluster) for r in found.collect())
    assert min(sizes.values()) >= 3 and {r for r, _ in sizes} <= {"kmeans-03", "density"}
    assert pooled_clusters(df.limit(4), "t")[0].count() == 0
    rows = coherent_clusters(df.withColumn("kind", F.element_at(F.split("t", " "), 2)), "kind", "t").collect()
    assert sum(r["size"] for r in rows) == 12 and all(0 < r.coherence <= 1 and len(r.top_types) <= 3 for r in rows)
    assert coherent_clusters(df.limit(0), "t", "t").count() == 0
