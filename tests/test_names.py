"""Names by difflib's ratio: the join, greedy leaders in rounds, origins and private brands, against sequential loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from aisleforge.operators import names as N
from aisleforge.operators import rules as R
from aisleforge.operators import similarity as S


def ratio(x, y):
    return SequenceMatcher(None, x, y).ratio()


def made(rng, n, letters="abcde"):
    """Names in families: each is a former one with some letters changed."""
    found = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(8)]
    while len(found) < n:
        w = list(rng.choice(found))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", *letters, *letters])
        found.append("".join(w))
    return found


@pytest.mark.parametrize("least", [0.5, 0.8, 0.85, 1.0])
def test_similar_names_equal_brute_force(spark, least):
    rng = random.Random(int(least * 100))
    left, right = [*made(rng, 120), "", None, "twin", "\U0001f600ab\U0001f600", "ab", "\U0001f601\U0001f602abcdef", "a" * 300], [*made(rng, 120), "", "twin", "\U0001f600ab", "abcdef", "a" * 250 + "b"]
    frames = [spark.createDataFrame([(n,) for n in side], "name string") for side in (left, right)]
    want = sorted((x, y, ratio(x, y)) for x in {*left} - {None, ""} for y in {*right} - {""} if ratio(x, y) >= least)
    assert sorted(tuple(r) for r in N.similar_names(*frames, least).collect()) == want and want


def test_letters_are_multisets(spark):
    df = spark.createDataFrame([("banana",), ("",), ("x\ny",)], "n string")
    assert [sorted(r.t) for r in df.select(N.letters(F.col("n")).alias("t")).collect()] == [["a0", "a1", "a2", "b0", "n0", "n1"], [], ["\n0", "x0", "y0"]]


def merged(rows, least):
    """One name after the other, as written."""
    counts = {}
    for b in rows:
        if b is not None:
            counts[b] = counts.get(b, 0) + 1
    order, clusters = sorted(counts, key=lambda b: (-counts[b], b)), []
    for name in order:
        home = next((c for c in clusters if name and c[0] and ratio(c[0].lower(), name.lower()) >= least), None)
        clusters.append([name]) if home is None else home.append(name)
    return {b: max(c, key=len) for c in clusters for b in c}


def test_leaders_equal_the_sequential_loop(spark):
    rng = random.Random(7)
    names = made(rng, 2000, "abcdefgh")
    rows = [n.title() if k % 5 == 0 else n for k, n in enumerate(names) for _ in range(rng.choice([1, 1, 1, 2, 5]))] + ["", None, None, "NOVA", "Nova", "nova"]
    found = S.leader_clusters(spark.createDataFrame([(b,) for b in rows], "brand string"), 0.85).collect()
    want = merged(rows, 0.85)
    assert len(found) == len(want) and {r.brand: r.leader for r in found} == want
    assert len(set(want.values())) < 0.9 * len(want)


def test_leaders_of_a_long_chain(spark):
    """Each node is like the next alone, so every other one leads."""
    nodes = [f"n{k:03d}" for k in range(30)]
    order = spark.createDataFrame([(n,) for n in nodes], "node string")
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a string, b string")
    found = {r.node: r.leader for r in N.greedy_leaders(order, edges).collect()}
    assert found == {n: nodes[k - k % 2] for k, n in enumerate(nodes)}
    assert N.greedy_leaders(order.limit(0), edges.limit(0)).count() == 0


def test_origins_equal_brute_force(spark):
    rng = random.Random(11)
    listed = [(n, rng.choice(["local", "international"])) for n in made(rng, 150)] + [("Acme", "local"), ("ACME ", "international"), ("same", "local"), ("sane", "international")]
    brands = [*made(rng, 150), None, "", "Unknown", " acme", "acmes", "ไทยabc", "samne"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(brands)], "k int, brand string")
    found = {r.k: (r.origin, r.origin_confidence, r.origin_method) for r in R.origin_cascade(df, spark.createDataFrame(listed, "brand string, origin string")).collect()}
    known = {}
    for n, o in listed:
        n = n.lower().strip()
        known[n] = "local" if "local" in (o, known.get(n)) else o
    for k, b in enumerate(brands):
        name = (b or "").lower().strip()
        if name in ("", "unknown"):
            want = ("unknown", 0.0, "no_brand")
        elif name in known:
            want = (known[name], 1.0, "exact_match")
        elif "ไ" in name:
            assert found[k][2] == "thai_script"
            continue
        else:
            local, other = (max((ratio(name, n) for n, o in known.items() if o == kind), default=0) for kind in ("local", "international"))
            want = ("local", local, "fuzzy_match") if local >= 0.8 and local > other else ("international", other, "fuzzy_match") if other >= 0.8 else ("unknown", 0.0, "unknown")
        assert found[k] == want, b
    assert len(found) == len(brands)


def test_private_brands_take_the_closest_pattern(spark):
    patterns = [("alpha water", "one"), ("alpha waters", "two"), ("ab", "short"), ("gamma", "three"), ("gammo", "four")]
    texts = ["alpha water", "alpha watre", "alpha watters", "gammi", "ac", "delta", "gammas!", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {r.k: (r.private_brand, r.confidence, r.method) for r in R.private_cascade(df, "k", {"name": F.array("t")}, patterns, 0.8).collect()}
    for k, t in enumerate(texts):
        best = max(((ratio(t, p), -i, b) for i, (p, b) in enumerate(patterns) if len(p) >= 3), default=(0, 0, None))
        if t == "alpha water":
            assert found[k] == ("one", 1.0, "exact_match")
        elif best[0] >= 0.8:
            assert found[k] == (best[2], best[0], "fuzzy_match"), t
        else:
            assert k not in found
    assert {found[k][0] for k in found} >= {"one", "three"}
