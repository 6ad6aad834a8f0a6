"""Near-duplicates, language-model scores, quality votes, toxicity, search, fixity, pipeline: against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aisleforge.llm import bytetext as bt
from aisleforge.llm import context_tree, minhash_dedup, quality_votes, queries, topk_search, toxicity_fm, warc_merkle
from aisleforge.operators.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, votes string, kept string, row string, cls string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "v", "k", "r", "c") for k, t in rows], SCHEMA).repartition(6)


def shingles(text):
    w = WORDS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), 1 << 60), doc)
    return [(doc, len(sets[i]), best[find(i)]) for i, (doc, _) in enumerate(rows)]


def near_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = [(1000 + k, t) for k, t in enumerate(["", None, " \n\t", "one", "ONE", "one two three", "One Two three", "a b c d e", "a b c d e"])]
    for group in range(4):
        base = [word() for _ in range(rng.choice([12, 40, 150]))]
        for k in range(40):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((group * 100 + k, " ".join(copy).upper() if k % 7 == 0 else " ".join(copy)))
    shared = [word() for _ in range(60)]
    rows += [(2000 + k, " ".join([*shared, *(word() for _ in range(rng.randint(10, 30)))])) for k in range(120)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [64, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 16)
    rows = near_texts()
    rows.append(rows[3])  # a repeated row
    found = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_without_ids_or_rows(spark):
    found = minhash_dedup.near_duplicates(frame(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, "q r s t u v"), (None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in found) == [(-1, -1, True), (-1, -1, True), (-1, 7, False), (7, 7, True)]
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Repeated and null ids: rows are judged by their texts, not by ids that others share; half of all rows are one group."""
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 7))) for _ in range(n))
    base, other, third = prose(100), prose(100), prose(100)
    rows = [(3, base), (5, base), (5, other), (None, base + " a"), (None, third), (None, third), (8, other + " b"), (9, None), (9, None), (None, "")]
    rows += [(100 + k, base + " " + "".join(rng.choice("xyz") for _ in range(4))) for k in range(40)] + [(3, base)] * 20
    kept = minhash_dedup.representatives(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted((r[0] or -1, r[1] or "") for r in kept) == sorted([(3, base), (5, other), (-1, third), (9, ""), (-1, "")])
    assert minhash_dedup.representatives(frame(spark, [])).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.5, 0.75, 0.9):
        n = int(1000 * share)
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])
        mins = minhash_dedup.minima(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        bits = minhash_dedup.packed_bits(mins)
        equal = minhash_dedup._equal(bits[:1], bits[1:])[0, 0]
        estimate = (equal / 320 - 0.25) / 0.75
        assert abs(estimate - n / (2000 - n)) < 0.16


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200}


def held_out(doc, parts):
    return doc is not None and zlib.crc32(str(doc).encode()) % parts == 0


def brute_tree(train, depth):
    """counts[(context, decided)] of every depth, and the mixture's probability of a 1."""
    counts = defaultdict(lambda: [0, 0])
    for data in train:
        data = b"\xff" * depth + data + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context, decided = data[i - d : i], 1
                for j in range(7, -1, -1):
                    bit = data[i] >> j & 1
                    counts[d, context, decided][bit] += 1
                    decided = decided << 1 | bit
    children = defaultdict(set)
    for d, context, decided in list(counts):
        if d:
            children[d - 1, context[1:], decided].add((d, context, decided))
    log_pe = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    weighted, share = {}, {}
    for node in sorted(counts, key=lambda x: -x[0]):
        own = log_pe(counts[node])
        if node[0] == depth:
            weighted[node], share[node] = own, 1.0
        else:
            below = sum(weighted[c] for c in children[node])
            weighted[node] = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            share[node] = 1 / (1 + math.exp(min(700, below - own)))

    def one(context, decided):
        p, rest = 0.0, 1.0
        for d in range(depth + 1):
            node = (d, context[depth - d :], decided)
            n = counts.get(node, [0, 0])
            # an unseen node has seen nothing: its estimate is even, and so is that of all below it
            s = share.get(node, 1.0)
            p += rest * s * (n[1] + 0.5) / (sum(n) + 1)
            rest *= 1 - s
        return p

    def score(data):
        data, total = b"\xff" * depth + data + b"\xff", 0.0
        for i in range(depth, len(data)):
            decided = 1
            for j in range(7, -1, -1):
                bit, p = data[i] >> j & 1, one(data[i - depth : i], decided)
                total += math.log10(p if bit else 1 - p)
                decided = decided << 1 | bit
        return total

    return score


@pytest.mark.parametrize("head", [1 << 17, 4])
def test_scores_equal_a_brute_force_tree(spark, monkeypatch, head):
    monkeypatch.setattr(context_tree, "HEAD_WORDS", head)
    monkeypatch.setattr(context_tree, "HEAD_GRAMS", head)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["abc", "Abd", "bca", "x", "é", "abc.", "zz"]) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(60, None), (61, " \n "), (62, "\tabc  Abd\n"), (3, rows[3][1])]
    found = context_tree.score(frame(spark, rows), depth=2).collect()
    plain = lambda t: WORDS.findall((t or "").translate(LOW))
    train = [t for k, t in rows if not held_out(k, 10)]
    counts = Counter(w for t in train for w in [*plain(t), "\0"])
    total, distinct = sum(counts.values()), len(counts)
    score = brute_tree([" ".join(plain(t)).encode() for t in train], 2)
    assert len(found) == len(rows)
    wanted = defaultdict(list)
    for k, t in rows:
        words = [*plain(t), "\0"]
        wanted[k].append((held_out(k, 10), len(words), sum(counts[w] > 0 for w in words), sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words), score(" ".join(plain(t)).encode())))
    for r in found:
        held, n, known, base, whole = wanted[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(whole, rel=1e-6)


def test_scores_of_nothing(spark):
    assert context_tree.score(frame(spark, [])).count() == 0
    assert context_tree.score(frame(spark, [(None, None)])).first()["n_tokens"] == 1


def test_model_beats_unigrams_on_held_out_texts(spark):
    found = queries.op2_context_tree_scores(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def naive_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    marked = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_quality_counts_and_rule(spark, small):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice(["a ", "b ", "é", "\n", "#", "a b c ", "\x0b", " ", "A!", "a\n"]) for _ in range(rng.randint(0, 60)))) for k in range(300)] + [(400, None), (401, ""), (5, "x"), (None, "y z")]
    found = quality_votes.judge(frame(spark, rows), keep=("doc_id", "text")).collect()
    assert len(found) == len(rows)
    for r in found:
        n, chars, symbols, dup, repeat = naive_counts(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == (n, chars, symbols, dup, repeat), r["text"]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
    assert quality_votes.judge(frame(spark, [])).count() == 0


def test_quality_rejects_labelled_junk_and_keeps_clean_texts(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    joined = queries.op7_quality_votes(spark, d).drop("quality").join(labels, "doc_id").filter("NOT base_failed")
    counts = {(r[0], r[1]): r[2] for r in joined.groupBy("quality", "kept").count().collect()}
    assert counts.get((0, True), 0) <= 0.05 * counts[0, False]
    assert counts.get((1, False), 0) <= 0.02 * counts[1, True]


def test_vote_model_finds_planted_accuracies():
    rng = np.random.default_rng(8)
    names = list(quality_votes.RULES.values())
    votes = Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        votes[tuple(int(rng.random() < (0.95 if good else (0.15 if r[0] == "symbols" else 0.95))) for r in names)] += 1
    share, given = quality_votes.fit([(list(v), n) for v, n in sorted(votes.items())])
    assert share[0] == pytest.approx(0.7, abs=0.05)
    assert given[3, quality_votes.CLASSES.index("symbols"), 0] > 0.75


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    found = queries.op9_toxicity_fm(spark, d)
    joined = found.filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    counts = {(r[0], r[1]): r[2] for r in joined.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.9 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.01 * counts[0, 0]


def test_machine_learns_a_pair_that_weights_cannot():
    """Label 1 only where exactly one of two terms is: additive weights cannot tell, a product can."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        texts.append(np.array([3] * int(a) + [5] * int(b) + [7], np.int32))
        labels.append(a != b)
    # the filter on single terms would drop both, so it is off
    machine = toxicity_fm.fit(texts, np.array(labels), 0.5, least=-1, factors=4, epochs=60)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    right = (machine.scores(np.concatenate(texts), first) >= 0.5) == np.array(labels)
    assert right.mean() > 0.95


def test_training_learns_a_pair_of_harmless_terms(spark):
    """With the production's defaults: either word is as frequent in clean as in toxic texts, and it is both or neither that is toxic."""
    rng = random.Random(3)
    filler = ["".join(rng.choice("etaoinshr") for _ in range(4)) for _ in range(300)]
    texts, labels = [], []
    for k in range(1600):
        both, one = k % 4 == 0, k % 4 == 1
        words = ["north", "river"] if both else ["north"] if one else ["river"] if k % 4 == 2 else []
        toxic = both or k % 4 == 3
        words += rng.sample(filler, 12)
        rng.shuffle(words)
        texts.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs = frame(spark, texts)
    machine = toxicity_fm.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = toxicity_fm.score(docs, machine).filter(toxicity_fm.held_out(F.col("doc_id"))).collect()
    right = [(r["score"] >= 0.5) == bool(labels[r["doc_id"]][2]) for r in held]
    assert len(right) > 200 and sum(right) > 0.95 * len(right)


def test_no_pair_of_a_term_ruled_out_is_over_the_bound():
    """Every way of splitting up to 24 toxic and 24 other texts of a term stays under what its toxic ones reach."""
    for a in range(25):
        for b in range(25):
            most = abs(float(toxicity_fm.contrast(np.array(a), np.array(a), np.array(0), np.array(b))))
            p, q = np.meshgrid(np.arange(a + 1), np.arange(b + 1), indexing="ij")
            z = np.abs(toxicity_fm.contrast(p, p + q, a - p, a + b - p - q))
            assert z.max() <= max(most, 2.0) + 1e-9, (a, b)


def test_paired_terms_by_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    labels = rng.random(400) < 0.4
    # a hot term in a third of the texts, rare ones, and pairs that go with the label
    texts = []
    for y in labels:
        held = set(np.flatnonzero(rng.random(30) < 0.2) * 1000)
        held |= {40000, 41000} if y and rng.random() < 0.5 else {40000} if rng.random() < 0.3 else {41000} if rng.random() < 0.3 else set()
        texts.append(np.array(sorted(held), np.int32))
    over, want = 3.0, set()
    terms = sorted({int(t) for x in texts for t in x})
    has = {t: np.array([t in x for x in texts]) for t in terms}
    for k, i in enumerate(terms):
        for j in terms[k + 1 :]:
            both = has[i] & has[j]
            z = [float(toxicity_fm.contrast((both & labels).sum(), both.sum(), (only & labels).sum(), only.sum())) for only in (has[i] & ~both, has[j] & ~both)]
            if z[0] * z[1] > 0 and min(map(abs, z)) > over:
                want |= {i, j}
    sample = toxicity_fm.Sample.of(texts, labels)
    assert {40000, 41000} <= want
    assert set(toxicity_fm.paired_terms(sample, over).tolist()) == want
    assert set(toxicity_fm.paired_terms(sample, over, spark, step=7).tolist()) == want
    none = toxicity_fm.Sample.of([], np.zeros(0, bool))
    assert not len(toxicity_fm.paired_terms(none, over))


def test_logits_are_the_double_sum():
    rng = np.random.default_rng(2)
    machine = toxicity_fm.Machine(np.zeros(1, np.int32), 0.3, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32))
    texts = [rng.choice(9, rng.integers(0, 9), replace=False) for _ in range(40)]
    found = machine.logits(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for t, logit in zip(texts, found, strict=True):
        pairs = sum(float(machine.v[i].astype(float) @ machine.v[j].astype(float)) for k, i in enumerate(t) for j in t[k + 1 :])
        assert logit == pytest.approx(0.3 + float(machine.w[t].astype(float).sum()) + pairs, abs=1e-9)


def test_fit_equals_a_plain_trainer():
    """Adagrad row by row with explicit pairs, on a table with shares of 1/4 and 3/4."""
    rng = np.random.default_rng(4)
    texts = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(300)]
    labels = np.array([(1 in t and 2 in t) or rng.random() < 0.05 for t in texts])
    share, factors, epochs, rate, l2 = float(labels.mean()), 3, 4, 0.2, 1e-4
    machine = toxicity_fm.fit(texts, labels, share, least=-1, factors=factors, epochs=epochs, rate=rate, l2=l2)
    n = len(machine.w)
    place = {b: int(machine.place[b]) for b in range(6)}
    rows = [sorted(place[int(b)] for b in t if place[int(b)] >= 0) for t in texts]
    rng = np.random.default_rng(7)
    alone = np.zeros(n)
    for b in range(6):
        p, q = sum(b in t for t, y in zip(texts, labels) if y) + 0.5, sum(b in t for t, y in zip(texts, labels) if not y) + 0.5
        odds = math.log(p / (labels.sum() + 1)) - math.log(q / ((~labels).sum() + 1))
        alone[place[b]] = math.copysign(max(0, abs(odds) - math.sqrt(1 / p + 1 / q)), odds)
    w0, w, v = math.log(share / (1 - share)), alone.copy(), rng.normal(0, 0.01, (n + 1, factors))[:n]
    g0, gw, gv = 1e-8, np.full(n, 1e-8), np.full((n, factors), 1e-8)
    weight = {True: share / labels.sum() * len(labels), False: (1 - share) / (~labels).sum() * len(labels)}
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 256):
            d0, dw, dv, used = 0.0, np.zeros(n), np.zeros((n, factors)), set()
            for i in order[lo : lo + 256]:
                r = rows[i]
                logit = w0 + sum(w[j] for j in r) + sum(float(v[a] @ v[b]) for k, a in enumerate(r) for b in r[k + 1 :])
                slope = (1 / (1 + math.exp(-logit)) - labels[i]) * weight[bool(labels[i])] / len(order[lo : lo + 256])
                d0 += slope
                for a in r:
                    used.add(a)
                    dw[a] += slope
                    dv[a] += slope * sum((v[b] for b in r if b != a), np.zeros(factors))
            g0 += d0 * d0
            w0 -= rate * d0 / math.sqrt(g0)
            for a in used:
                x, y = dw[a] + l2 * (w[a] - alone[a]), dv[a] + l2 * v[a]
                gw[a] += x * x
                gv[a] += y * y
                w[a] -= rate * x / math.sqrt(gw[a])
                v[a] -= rate / 4 * y / np.sqrt(gv[a])
    assert n == 6 and np.allclose(machine.w, w, atol=1e-4) and np.allclose(machine.v, v, atol=1e-4)
    assert machine.w0 == pytest.approx(w0, abs=1e-4)


def test_nothing_to_tell_labels_by_gives_their_share(spark):
    docs = frame(spark, [(k, "the same words") for k in range(200)])
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 3)) for k in range(200)], "doc_id long, quality int, toxic int")
    machine = toxicity_fm.train(docs, labels)
    trained = [k for k in range(200) if not held_out(k, 5)]
    share = sum(k % 10 == 3 for k in trained) / len(trained)
    assert [r["score"] for r in toxicity_fm.score(docs, machine).collect()] == pytest.approx([share] * 200, abs=1e-6)


def test_labels_that_disagree_and_repeated_ids(spark):
    """An id labelled both ways is toxic, whatever the order of rows; kept columns named like an output give way."""
    docs = frame(spark, [(k, "awful words here" if k % 2 else "fine words here") for k in range(400)] + [(1, "fine words here")] * 50)
    rows = [(k, 1, 0) for k in range(400)] + [(k, 1, 1) for k in range(400) if k % 2]
    held = [toxicity_fm.score(docs.withColumn("score", F.lit("x")), toxicity_fm.train(docs, spark.createDataFrame(r, "doc_id long, quality int, toxic int")), keep=("doc_id", "score", "text")).collect() for r in (rows, rows[::-1])]
    for found in held:
        assert all((r["score"] >= 0.5) == ("awful" in r["text"]) for r in found) and len(found) == 450
    assert sorted(r["score"] for r in held[0]) == sorted(r["score"] for r in held[1])


def test_small_tables_keep_clean_documents(spark, small):
    """No collapse to one label where few rows are labelled."""
    found = {r[0]: r[1] for r in queries.op9_toxicity_fm(spark, small).groupBy("predicted").count().collect()}
    assert found[0] >= 0.85 * sum(found.values())


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "x"), (2, "")])
    labels = spark.createDataFrame([(1, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity_fm.train(docs, labels)
    assert [r["score"] for r in toxicity_fm.score(docs, machine).collect()] == pytest.approx([0.0] * 4, abs=1e-6)
    assert toxicity_fm.score(frame(spark, []), machine).count() == 0


def test_top_k_equals_all_products(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(700, 24)), 1).astype(np.float32)
    rows = [(k, v.tolist(), "t") for k, v in enumerate(x)] + [(2000, None, "t"), (2001, [float("nan")] * 24, "t"), (2002, [1.0, None], "t"), (2020, [1.0, 2.0], "t"), (2021, [3.0, 1.0], "t"), (15, x[15].tolist(), "t")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").repartition(4)
    found = defaultdict(list)
    for r in topk_search.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, groups=3).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    e = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    ids, data = np.append(np.arange(700), 15), np.vstack([e, e[15]])
    for q in range(0, 700, 20):
        scores = data @ e[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert sorted(found[q]) == [(k + 1, ids[i], scores[i]) for k, i in enumerate(order)]
    assert found[2020] == [(1, 2021, 64 * 3 * 64 + 64 * 2 * 64)]
    assert topk_search.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("pivots", [False, True])
def test_top_k_over_many_blocks(spark, monkeypatch, pivots):
    """Clustered vectors in small blocks and cells, more queries than one block holds."""
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 16)
    if pivots:
        monkeypatch.setattr(topk_search, "PER_PIVOT", 100)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(12, 16)), 100, axis=0) + 0.1 * rng.normal(size=(1200, 16))
    x[::9] = x[0]  # ties
    found = defaultdict(list)
    for r in topk_search.top_k(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 7 == 0, k=20).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    e = np.floor(64 * x).astype(np.int64)
    for q in range(0, 1200, 7):
        scores = e @ e[q]
        order = [i for i in np.lexsort((np.arange(1200), -scores)) if i != q][:20]
        assert sorted(found[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]


def test_bounds_drop_most_candidates_of_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(50, 64)) * np.linspace(2, 0.1, 64)
    data = np.floor(64 * (np.repeat(centres, 80, axis=0) + 0.05 * rng.normal(size=(4000, 64)))).T
    queries, names = np.ascontiguousarray(data[:, :32].T), np.arange(32)
    _, _, score = topk_search.best_of_block(names, queries, np.arange(4000), data, 20)
    tally = [0, 0]
    q, ids, again = topk_search.best_of_block(names, queries, np.arange(4000), data, 20, score.reshape(32, 20)[:, -1], tally=tally)
    assert (again == score).all() and tally[1] == 32 * 4000 and tally[0] < 0.1 * tally[1]


def test_search_bounds_hold_for_large_numbers():
    a, b = np.array([[2.0**40, -(2.0**40)]]), np.array([[2.0**40, 1.0], [3.0, 2.0**40]])
    assert topk_search._product(a, b).tolist() == [[2**63 - 1, -(2**63)]]


def test_audit_finds_planted_damage(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k % 3}", "p" * (k % 50)) for k in range(3000)] + [(7, "http://again", "dup"), (None, None, None)], "page_id long, url string, html string")
    replica = pages.filter("page_id IS NULL OR page_id NOT IN (100, 2999)").withColumn("html", F.when(F.col("page_id").isin(5, 2048), "bad").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(5000, "u", "h")], pages.schema))
    found = {r["page_id"]: r["status"] for r in warc_merkle.audit(pages, replica).filter("status <> 'intact'").collect()}
    assert found == {5: "changed", 2048: "changed", 100: "missing", 2999: "missing", 5000: "extra"}
    same = warc_merkle.audit(pages, pages)
    assert same.filter("status <> 'intact'").isEmpty() and same.count() == 3001
    offsets = {r["page_id"]: (r["offset"], r["length"]) for r in same.filter("file = 1").collect()}
    assert offsets[1024][0] == 0 and all(offsets[k + 1][0] == sum(offsets[k]) for k in range(1024, 2047))
    assert warc_merkle.audit(pages.limit(0), pages.limit(0)).count() == 0


def test_audit_of_extreme_ids(spark):
    top = 2**60 + 1023
    ids = [top, top + 1, 2**63 - 1, -(2**63), -1, 0, 2**53 + 1, 2**53 + 2]
    pages = spark.createDataFrame([(k, "u", None) for k in ids], "page_id long, url string, html string")
    replica = pages.filter(f"page_id <> {top + 1}").withColumn("html", F.when(F.col("page_id") == top, " "))
    found = {r["page_id"]: (r["file"], r["status"]) for r in warc_merkle.audit(pages, replica).collect()}
    assert {k: f for k, (f, _) in found.items()} == {k: k >> 10 for k in ids}
    assert {k: s for k, (_, s) in found.items() if s != "intact"} == {top: "changed", top + 1: "missing"}


def test_audit_query_on_odd_pages(spark, tmp_path):
    """Null html, url and ids, repeated ids: the query and its SQL agree."""
    import duckdb

    rows = [(k, f"http://x/{k}", None if k % 3 else "h" * k) for k in range(300)] + [(7, "again", None), (7, None, "x"), (None, None, None), (5, "a", "b"), (-3, "n", "m"), (-3, "n", "m")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.AUDIT_SQL).df()
    got = queries.op4_warc_merkle_audit(spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(object).values.tolist())) == sorted(map(tuple, want.astype(object).values.tolist()))


def test_nodes_cover_byte_ranges(spark):
    """Records that swap lengths between them keep no parent's hash."""
    leaf = "node long, file long, n long, length long, hash string, offset long"
    a, b = (spark.createDataFrame([(0, 0, 1, x, "h0", 0), (1, 0, 1, y, "h1", x)], leaf) for x, y in ((10, 20), (20, 10)))
    assert warc_merkle.build(a, 1).root != warc_merkle.build(b, 1).root


def test_windows_and_lines():
    held = ["a b c d", "", "x", "p q\nr\n\np q"]
    block = next(bt.blocks(pa.array(held)))
    words = bt.words(block, lower=False)
    assert np.diff(words.first).tolist() == [4, 0, 1, 5]
    _, first = bt.windows(words, 3)
    assert np.diff(first).tolist() == [2, 0, 0, 3]
    _, first = bt.windows(words, 3, whole_if_short=True)
    assert np.diff(first).tolist() == [2, 0, 1, 3]
    lines = bt.lines(block)
    assert np.diff(lines.first).tolist() == [1, 1, 1, 4]
    assert lines.hashes[3] == lines.hashes[6] and lines.hashes[4] != lines.hashes[3]


def test_sql_of_the_queries(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, small).toPandas()
        want = con.execute(sql).df()
        columns = sorted(want.columns)
        assert set(columns) <= set(got.columns)
        assert sorted(map(tuple, got[columns].astype(object).values.tolist())) == sorted(map(tuple, want[columns].astype(object).values.tolist())), name
