"""Queries that once read only part of their rows, against brute force on small tables with planted cases."""

import hashlib
import math
import re
from collections import Counter

import pytest

from aisleforge.plans import QUERIES, assortment, portfolio, texts

PRODUCTS = "supermarket string, brand string, product_type string, category string, line int, confidence double, supplier int, part int"
#: every line number, confidence and supplier in both stores; Oak and Fir, and two categories, in one store only
ROWS = [
    ("store_a", "Elm", "tea", "Drinks", 1, 0.91, 4, 5), ("store_a", "Elm", "tea", "Drinks", 6, 0.99, 1, 3), ("store_a", "Oak", "soap", "Household", 2, 0.5, 2, 2), ("store_a", None, "tea", "Drinks", 7, 0.98, 1, 3), ("store_a", "Yew", "jam", "Food", 3, 0.9, 3, 1),
    ("store_b", "Elm", "tea", "Drinks", 6, 0.99, 1, 3), ("store_b", "Fir", "milk", "Dairy", 4, 0.9, 5, 7), ("store_b", "Fir", "milk", "Dairy", 1, 0.99, 10, 14), ("store_b", None, "tea", "Drinks", 2, 0.7, 1, 3), ("store_b", "Yew", "jam", "Food", 5, 0.8, 2, 9),
]


@pytest.fixture
def both_stores(spark, monkeypatch):
    monkeypatch.setattr(assortment, "products", lambda session, sf_dir: session.createDataFrame(ROWS, PRODUCTS))


def test_whole_stores_are_aligned(spark, both_stores):
    counts = {s: Counter(r[1] for r in ROWS if r[0] == s and r[1]) for s in ("store_a", "store_b")}
    want = {b: (counts["store_a"][b], counts["store_b"][b], counts["store_a"][b] + counts["store_b"][b]) for b in counts["store_a"] | counts["store_b"]}
    assert {r.brand: (r.store_a, r.store_b, r.total) for r in QUERIES["outer_align"](spark, "").collect()} == want


def test_sets_are_those_of_the_whole_stores(spark, both_stores):
    sets = {key: [{f(r) for r in ROWS if r[0] == s} for s in ("store_a", "store_b")] for key, f in (("brand", lambda r: f"{r[1] or '?'}/{r[2]}"), ("category", lambda r: r[3]))}
    for key, (a, b) in sets.items():
        found = QUERIES[f"{key}_overlap"](spark, "").first()
        assert (found.size_a, found.size_b, found.shared, found.only_a, found.only_b) == (len(a), len(b), len(a & b), len(a - b), len(b - a))
        assert found.overlap_pct == pytest.approx(100 * len(a & b) / min(len(a), len(b)), abs=1e-6)
    a, b = sets["brand"]
    assert QUERIES["overlap_band"](spark, "").first().differentiation == "Low"
    want = {(k, "both") for k in a & b} | {(k, "only_a") for k in a - b} | {(k, "only_b") for k in b - a}
    assert {(r.k, r.side) for r in QUERIES["brand_set_operations"](spark, "").collect()} == want


HEAD = "a heading that all of these documents share word for word: "
WORDS = [f"word{k}" for k in range(60)]
#: 1 and 2 are equal; 3 shares 1's heading and most of its words; 4 and 5 are near copies with another start; 6 is alone
TEXTS = {1: HEAD + " ".join(WORDS), 2: HEAD + " ".join(WORDS), 3: HEAD + " ".join(WORDS[:45]), 4: "once " + " ".join(WORDS[::-1]) + " twice", 5: "twice " + " ".join(WORDS[::-1]) + " once", 6: "nothing like the rest"}


def embedded(text):
    v = [b for salt in range(3) for b in hashlib.md5(f"{text}_{salt}".encode()).digest()]
    return [x / math.sqrt(sum(y * y for y in v)) for x in v]


def linked(near):
    """(node: root) of the texts for which near(cosine, jaccard) holds, by brute force."""
    root = {k: k for k in TEXTS}
    for a in TEXTS:
        for b in TEXTS:
            words = [set(re.findall(r"[a-z0-9]{2,}", TEXTS[k])) for k in (a, b)]
            cosine = sum(x * y for x, y in zip(embedded(TEXTS[a]), embedded(TEXTS[b]), strict=True))
            if a < b and near(cosine, len(words[0] & words[1]) / len(words[0] | words[1])):
                old, new = sorted((root[a], root[b]), reverse=True)
                root = {k: new if r == old else r for k, r in root.items()}
    grouped = Counter(root.values())
    return {k: r for k, r in root.items() if grouped[r] > 1}


@pytest.mark.parametrize(
    "name, near",
    [("product_duplicates", lambda cosine, jaccard: 1 - (0.4 * cosine + 0.3 * jaccard + 0.3) * 0.95 <= 0.15), ("image_clusters", lambda cosine, jaccard: 1 - (0.6 * cosine + 0.4 * jaccard) <= 0.2)],
)
def test_embeddings_are_those_of_whole_texts(spark, tmp_path, name, near):
    rows = [(k, t, "en", "web", len(t)) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    want = linked(near)
    assert {1, 2, 4, 5} <= set(want) and 6 not in want
    assert {r.node: r.root for r in QUERIES[name](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", sorted(portfolio.EDGES))
def test_buckets_hold_every_line(spark, monkeypatch, name):
    """Keys of 1 to 25 rows, on line numbers other than 7 too."""
    rows = [("store_a", f"B{n}", "tea", k % 7 + 1) for n in range(1, 26) for k in range(n)]
    monkeypatch.setattr(portfolio, "products", lambda session, sf_dir: session.createDataFrame(rows, "supermarket string, brand string, product_type string, line int"))
    want = {label: sum(lo <= n <= (hi or 25) for n in range(1, 26)) for label, lo, hi in portfolio.EDGES[name]}
    assert {r.bucket: r["keys"] for r in QUERIES[name](spark, "").collect()} == want


def test_names_match_at_the_configured_ratios(spark, monkeypatch):
    """Ratios between the configured ones and those the queries once had: Brand#203 to Brand#20 0.94, grand#1 to brand#1 0.857, Nova Gold tea to Nova Golt teas 0.89."""
    rows = [(1, "Brand#203", "jam", 3), (2, "Nova Gold", "tea", 2), (3, "Nova Golt", "teas", 1), (4, "Grand#1", "soap", 1)]
    for plans in (assortment, texts):
        monkeypatch.setattr(plans, "products", lambda session, sf_dir: session.createDataFrame(rows, "part int, brand string, product_type string, n int"))
    origins = {r.brand: (r.origin, r.origin_method) for r in QUERIES["brand_origins"](spark, "").collect()}
    assert origins["Brand#203"] == ("international", "fuzzy_match")
    assert {r.part: r.private_brand for r in QUERIES["private_brands"](spark, "").collect()}.get(4) == "house one"
    leaders = {r.brand: r.leader for r in QUERIES["brand_consolidation"](spark, "").collect()}
    assert leaders["Nova Gold tea"] == leaders["Nova Golt teas"] == "Nova Golt teas"
