"""Importance resampling, substring dedup and vector codes: against brute force, on odd rows, with their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from aisleforge.llm import bytetext as bt
from aisleforge.llm import fm_index, importance_resampling, queries, substring_dedup, vector_codes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns besides id and text whose names are those of outputs and of inner columns.
EXTRA = "t string, id string, h string, rank string, stream string, starts string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, *"abcdefg") for k, t in rows], "doc_id long, text string, " + EXTRA).repartition(5)


def odd_texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["Été", "naïve", "x1", "A", "zz", "日本", "q" * 70, "don't", "ok"])
    rows = [(k, t) for k, t in enumerate([None, "", " \t\n", "one", "- - -", "x" * 100_000, "w " * 30_000])]
    rows += [(100 + k, " ".join(word() for _ in range(rng.randint(1, 60)))) for k in range(80)]
    return rows + [rows[5], rows[90 % len(rows)], (None, "a b c d " * 10), (3, "another text of row three")]


def resampled(rows, target, percent, least, longest, buckets):
    def features(t):
        w = TERMS.findall((t or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    held = [(k, *features(t)) for k, t in rows]
    s, t = Counter(b for *_, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    total, aimed = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aimed + buckets))))
    out = []
    for k, n_words, f in held:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    rows, target = odd_texts(), ["ok Été naïve naïve", None, "A b c"]
    found = importance_resampling.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=40, least_words=5, longest=longest, buckets=512)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == resampled(rows, target, 40, 5, longest, 512)


def test_resampling_of_empty_tables(spark):
    nothing = frame(spark, []).limit(0)
    assert importance_resampling.resample(nothing, nothing).count() == 0
    found = importance_resampling.resample(frame(spark, [(1, "a b " * 20), (2, "c d " * 20)]), nothing, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in found) == [0, 1] and all(r["weight"] != 0 for r in found)
    with pytest.raises(ValueError, match="16 bits"):
        importance_resampling.streams(nothing, buckets=70_000)


def test_streams_are_packed(spark):
    held = importance_resampling.streams(frame(spark, [(1, "a b a"), (2, None)])).collect()
    found = {r["doc_id"]: np.frombuffer(r["stream"], "<u2").tolist() for r in held}
    a, b = zlib.crc32(b"a") % 10_000, zlib.crc32(b"b") % 10_000
    assert found == {1: [a, b, a], 2: []}


def test_checksums_of_ranges():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts, ends = np.array([0, 5, 5, 100, 7]), np.array([1, 5, 45, 700, 8])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert importance_resampling.crc32_spans(data, starts, ends).tolist() == want


@pytest.mark.parametrize("threshold", [1, 2, 3, 5, 8])
def test_matching_statistics_equal_brute_force(threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(30):
        sizes, asked = rng.integers(0, 16, rng.integers(0, 8)), rng.integers(0, 20, rng.integers(1, 9))
        words, streamed = (rng.integers(0, top, n.sum()).astype(np.uint64) * np.uint64(977) for top, n in ((3, sizes), (4, asked)))
        marks = rng.integers(0, 50, len(sizes))
        first = {}
        for held, mark in zip(np.split(words, np.cumsum(sizes))[:-1], marks.tolist(), strict=True):
            for i in range(len(held) - threshold + 1):
                key = tuple(held[i : i + threshold].tolist())
                first[key] = min(first.get(key, mark), mark)
        want = []
        for text in np.split(streamed, np.cumsum(asked))[:-1]:
            want += [first.get(tuple(text[i : i + threshold].tolist()), -1) if i + threshold <= len(text) else -1 for i in range(len(text))]
        held, found = fm_index.FmIndex(words, sizes, marks, threshold).statistics(streamed, asked)
        assert found.tolist() == want and ((held == threshold) == (found >= 0)).all()


def passages(rng):
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefgh")
    prose = lambda n: [word() for _ in range(n)]
    shared, quoted = prose(120), [prose(rng.randint(45, 90)) for _ in range(4)]
    rows = [(k, t) for k, t in enumerate([None, "", "  ", "one", "a " * 49, "a " * 50, "a " * 400, "A " * 60, "b a " * 300])]
    for k in range(60):
        w = prose(rng.randint(0, 40)) + shared[rng.randint(0, 40) : rng.randint(70, 120)] + prose(rng.randint(0, 5)) + rng.choice(quoted) + prose(rng.randint(0, 90))
        rows.append((100 + k, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(300 + k, rows[20][1]) for k in range(30)] + [rows[20], (120, rows[30][1]), (None, rows[20][1]), (None, rows[40][1])]
    rng.shuffle(rows)
    return rows


def deduped(rows, length):
    earliest = {}
    held = [(float("inf") if k is None else k, k, WORDS.findall(t or "")) for k, t in rows]
    for place, _, w in held:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            earliest[key] = min(earliest.get(key, place), place)
    out = []
    for place, k, w in held:
        gone = {j for i in range(len(w) - length + 1) if earliest[tuple(w[i : i + length])] < place for j in range(i, i + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [substring_dedup.CROWD, 3])
def test_dedup_equals_brute_force(spark, monkeypatch, crowd):
    """With a small CROWD most anchors are settled window by window."""
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "SHARD", 40)
    rows = passages(random.Random(crowd))
    found = substring_dedup.dedup(frame(spark, rows), texts=True)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == deduped(rows, 50) and sum(r[2] for r in got) > 1000


def test_dedup_of_other_lengths_and_empty_tables(spark):
    rows = passages(random.Random(9))[:60]
    found = substring_dedup.dedup(frame(spark, rows), length=33, texts=True)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == deduped(rows, 33)
    assert substring_dedup.dedup(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="32 words"):
        substring_dedup.dedup(frame(spark, rows), length=20)


def test_stretches_cover_every_window_once():
    texts = ["a " * 300, " ".join(str(i * i % 97) for i in range(500)), "x " * 49, "", " ".join(map(str, range(50)))]
    words = bt.words(next(bt.blocks(pa.array(texts))), lower=False)
    found = substring_dedup.stretches(words, 50)
    windows = sorted((r, a + k) for r, a, n in zip(found["row"].tolist(), found["at"].tolist(), found["n"].tolist(), strict=True) for k in range(n))
    assert windows == [(r, i) for r, t in enumerate(texts) for i in range(len(t.split()) - 49)]
    assert found["n"].max() <= 35


def coded(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(k, label, [math.floor(scale * np.float64(np.float32(c))) for c in v]) for k, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    kept = [r for r in kept if len(r[2]) == width * parts]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    seen = {}
    for k, _, x in kept:
        seen.setdefault(k, x)
    books = [[cut(x, p) for x in list(seen.values())[:entries]] for p in range(parts)]
    off = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (off(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for *_, x in kept:
                own[nearest(cut(x, p), books[p])].append(cut(x, p))
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else books[p][e] for e, o in enumerate(own)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, errors = [], Counter()
    for k, label, x in kept:
        codes = [nearest(cut(x, p), books[p]) for p in range(parts)]
        error = sum(off(cut(x, p), books[p][c]) for p, c in enumerate(codes))
        errors[label] += error
        out.append((k, bytes(codes).hex(), error, label, sha))
    return sorted(((k, c, e, errors[label], s) for k, c, e, label, s in out), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, label, "x", "y") for k, v, label in rows], "vec_id long, embedding array<float>, label int, code string, x string").repartition(4)


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, [round(rng.gauss(0, 1) * rng.choice([0.1, 1, 4]), 2) for _ in range(16)], rng.choice([None, 0, 1, 1, 1])) for k in range(200, 400)]
    rows += [(500 + k, rows[0][1], 7) for k in range(40)] + [(600 + k, [1.0, -1.0] * 8, None) for k in range(10)]  # copies and ties
    rows += [(201, rows[5][1], 0), (202, rows[2][1], 1), (None, rows[9][1], None)]  # repeated ids, equal rows, no id
    rows += [(1, None, 0), (2, [float("nan")] * 16, 0), (3, [None] * 16, 0), (4, [float("inf")] * 16, 1), (900, [1.0] * 8, 1), (5, [], 1)]
    found = vector_codes.compress(vectors(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == coded([r for r in rows if r[1] != []])


def test_codes_of_few_and_no_vectors(spark):
    rows = [(k, [float(k)] * 8, k) for k in range(3)]
    assert sorted((tuple(r) for r in vector_codes.compress(vectors(spark, rows)).collect()), key=repr) == coded(rows)
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, [1.0] * 9, 1)])).count() == 0  # 8 does not divide 9
    huge = vector_codes.compress(vectors(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)])).collect()
    assert [r["error"] for r in huge] == [0, 0]


def test_annuli_prune_and_are_exact():
    rng = np.random.default_rng(8)
    entries = (rng.normal(size=(64, 4)) * rng.gamma(2, 500, (64, 1))).astype(np.int64)
    entries[7] = entries[3]
    x = np.concatenate([(rng.normal(size=(2000, 4)) * 1500).astype(np.int64), entries, np.zeros((1, 4), np.int64)])
    tally = [0]
    code, off = vector_codes.Annuli(entries).nearest(x, tally)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (off == every.min(axis=1)).all()
    assert tally[0] < 0.6 * every.size


def test_queries_on_odd_rows_equal_their_sql(spark, tmp_path):
    """Null and empty texts, nothing but short ones, null vectors: the queries and their SQL agree."""
    texts = [(k, t) for k, t in passages(random.Random(2)) if k is not None]
    texts = list({k: (k, t) for k, t in texts}.values())
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "ab cd ab"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)] if k % 9 else None, k % 3 or None) for k in range(90)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op11_importance_resampling", "op12_substring_dedup", "op13_vector_codes"):
        got = queries.queries()[name](spark, str(tmp_path)).toPandas()
        want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
        values = lambda d: sorted((tuple(None if pd.isna(v) else v for v in r) for r in d.astype(object).values.tolist()), key=repr)
        assert values(got) == values(want), name
