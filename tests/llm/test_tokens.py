"""Token counts, ids, wavelet shards, packing and SentencePiece against the libraries and by round trips."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aisleforge.llm import bytetext as bt
from aisleforge.llm import packing, queries, sentencepiece_scan, token_counts, wavelet_store, word_ids

BYTE, WORD, PIECE = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, extra string, n_tokens string, shard string"
ODD = [
    "", " ", "  a  b ", "a\n b\n\n c\n", "don't 's 'S it's<|endoftext|> x <|endoftext|>", "<|ENDOFTEXT|>", "aaaaaaaaaaaaaaaa " * 3, "x y　z", "日本語のテキスト。です!", "\t\tfoo\t bar", "a,b,,c ,,d 12,3 3a a3",
    "é,é ́x …!! !…", "İstanbul ΣΑΣ", "'''s 're'x''", "<|startoftext|>hi", "a \r\n b", "x\x1c y \x1c", "trail   ", "\n\nx", "word " * 3000, "y" * 5000, "a  b c",
]


def texts():
    rng = random.Random(3)
    parts = ["a", "B", "é", "'", "s", "t", " ", " ", "\n", ",", "1", "!", " ", "<|endoftext|>", "…", "\t", "ll", "́", "日", "　", "$", "▁"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]


def rows():
    found = [(k, t, "x", "y", "z") for k, t in enumerate(texts())]
    return found + [(900_001, None, None, None, None), (5, found[5][1], "x", "y", "z"), (None, "no id", "x", "y", "z")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def test_counts_equal_the_library(docs):
    library = Tokenizer.from_file(BYTE)
    found = token_counts.token_counts(docs, BYTE, P.PATTERN, keep=("doc_id", "text")).collect()
    assert len(found) == len(rows())
    for r in found:
        assert r["n_bytes"] == len((r["text"] or "").encode())
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]


@given(st.lists(st.text(max_size=40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_counts_and_ids_of_any_text(held):
    library, words = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    held = [t.encode("utf-8", "ignore").decode() for t in held]
    for block in bt.blocks(pa.array(held, pa.string())):
        part = held[block.lo : block.hi]
        assert token_counts.count_block(block, BYTE, P.PATTERN).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in part]
        ids, first = word_ids.encoder(WORD).encode(block)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [words.encode(t, add_special_tokens=False).ids for t in part]


def test_small_blocks_cut_between_texts():
    held = pa.array(texts())
    whole = np.concatenate([token_counts.count_block(b, BYTE, P.PATTERN) for b in bt.blocks(held)])
    cut = np.concatenate([token_counts.count_block(b, BYTE, P.PATTERN) for b in bt.blocks(held, 50)])
    assert (whole == cut).all()


@given(st.lists(st.integers(0, 300), max_size=700))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(ids):
    ids = np.array(ids, np.int64)
    data = wavelet_store.to_file(wavelet_store.WaveletMatrix.build(ids, 9), np.arange(2), np.ones(2, bool), np.array([len(ids), 0]))
    matrix, _, _, lengths = wavelet_store.from_file(data)
    assert (matrix.decode() == ids).all() and lengths.tolist() == [len(ids), 0]
    at = np.arange(len(ids))
    assert (matrix.access(at) == ids).all()
    for token in {*ids[:5].tolist(), 0, 300, 511}:
        where = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(where)
        assert matrix.rank(token, np.array([0, len(ids) // 2, len(ids)])).tolist() == [0, int((where < len(ids) // 2).sum()), len(where)]
        assert [matrix.select(token, k) for k in range(min(3, len(where)))] == where[:3].tolist()
        assert matrix.select(token, len(where)) == -1


def test_wavelet_rank_over_many_blocks():
    ids = np.random.default_rng(1).integers(0, 50000, 20_000)
    matrix = wavelet_store.WaveletMatrix.build(ids, 16)
    at = np.random.default_rng(2).integers(0, len(ids), 500)
    assert (matrix.access(at) == ids[at]).all() and (matrix.decode() == ids).all()
    token = int(ids[77])
    assert matrix.rank(token, at).tolist() == [int((ids[:p] == token).sum()) for p in at]


def test_wavelet_select_and_wide_ids():
    ids = np.random.default_rng(3).integers(0, 300, 200_000)
    matrix, *_ = wavelet_store.from_file(wavelet_store.to_file(wavelet_store.WaveletMatrix.build(ids, 9), np.zeros(1), np.ones(1, bool), np.array([len(ids)])))
    where = np.flatnonzero(ids == 77)
    assert [matrix.select(77, k) for k in (0, 100, len(where) - 1)] == where[[0, 100, -1]].tolist()
    lazy, *_ = wavelet_store.from_file(wavelet_store.to_file(matrix, np.zeros(1), np.ones(1, bool), np.array([len(ids)])))
    assert lazy.access(np.array([150_000])).tolist() == [ids[150_000]] and all(len(p.held) == 1 for p in lazy.planes)
    wide = np.array([0, 65_536, 70_000])
    assert wavelet_store.WaveletMatrix.build(wide, 17).decode().tolist() == wide.tolist()
    with pytest.raises(ValueError):
        wavelet_store.WaveletMatrix.build(wide, 16)


def test_store_reads_back_what_was_written(docs, monkeypatch):
    monkeypatch.setattr(wavelet_store, "SHARD_TOKENS", 500)
    library = Tokenizer.from_file(WORD)
    found = wavelet_store.read_shards(wavelet_store.write_shards(docs, WORD, end_id=2)).collect()
    held = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    by_start = sorted(found, key=lambda r: r["start"])
    assert len(by_start) == len(held)
    for r, (doc_id, text, *_) in zip(by_start, held, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), crc(ids))
        assert (r["last_id"], r["n_last"]) == (2, ids.count(2))
        start += len(ids)


def check_packing(found, wanted, capacity, encode):
    """Every piece there once, with its ids, gapless in its sequence."""
    assert sorted((r["doc_id"] or -1, r["piece"]) for r in found) == sorted((i or -1, p) for i, t in wanted for p in range(-(-len(encode(t)) // capacity)))
    sequences = {}
    for r in found:
        assert r["start"] == r["piece"] * capacity and 0 < r["length"] <= capacity
        assert any(crc(encode(t)[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for i, t in wanted if i == r["doc_id"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs):
    library = Tokenizer.from_file(WORD)
    known = {}

    def encode(text):
        if text not in known:
            known[text] = library.encode(text or "", add_special_tokens=False).ids + [1]
        return known[text]

    found = packing.pack(docs, WORD, end_id=1, capacity=64).collect()
    n = check_packing(found, [(r[0], r[1]) for r in rows()], 64, encode)
    total = sum(r["length"] for r in found)
    assert n <= 1.02 * total / 64 + 2


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_a_packing_close_to_the_bound(counts):
    plan = packing.Plan(counts, 100)
    load, seen = {}, {}
    for size, rank0, bin0, offset0, each in plan.runs:
        n = min(counts[size], next((r for s, r, *_ in sorted(plan.runs) if s == size and r > rank0), counts[size])) - rank0
        for k in range(n):
            load.setdefault(bin0 + k // each, []).append((offset0 + k % each * size, size))
        seen[size] = seen.get(size, 0) + n
    assert seen == counts
    for parts in load.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 100 and sum(3 * s > 100 for _, s in parts) <= 2
    assert len(load) == plan.bins
    total = sum(s * n for s, n in counts.items())
    over_half = sum(n for s, n in counts.items() if 2 * s > 100)
    assert plan.bins <= max(1.5 * total / 100 + 1, over_half + 1.5 * total / 100 + 1)


def pieces_of(held, chunk=None, limit=bt.BLOCK_BYTES):
    vocabulary, found = sentencepiece_scan.vocabulary(PIECE), []
    for block in bt.blocks(pa.array(held, pa.string()), limit):
        ids, first = vocabulary.encode(block, chunk)
        found += [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]
    return found


GIANT = ["abcdefgh" * 700, "zq" * 4000, "thanedble" * 900, "a" * 15_000, "日本語です" * 1500, "ab " * 9000, " " * 9000, "x" + "▁" * 5000 + "y", "1234567890" * 900, "😀é" * 3000, "the end of it\n" * 1000]


@pytest.mark.parametrize("chunk", [None, 128, 300])
def test_pieces_equal_the_library(chunk):
    """Hostile and giant texts, whatever the chunks are; each text over a chunk goes through the scan."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    held = [*texts(), *GIANT]
    vocabulary = sentencepiece_scan.vocabulary(PIECE)
    vocabulary.n_chunked = 0
    assert pieces_of(held, chunk) == [library.encode(t) for t in held]
    assert vocabulary.n_chunked == sum(len(t.encode()) + 1 > (chunk or sentencepiece_scan.CHUNK) for t in held if t)


def test_pieces_of_documents_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    held = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    vocabulary = sentencepiece_scan.vocabulary(PIECE)
    vocabulary.n_chunked = 0
    assert pieces_of(held) == [library.encode(t) for t in held]
    assert vocabulary.n_chunked == sum(len(t.encode()) + 1 > sentencepiece_scan.CHUNK for t in held) > 50


@given(st.lists(st.text(max_size=400), max_size=6))
@settings(max_examples=60, deadline=None)
def test_pieces_of_any_text(held):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    held = [t.encode("utf-8", "ignore").decode() for t in held]
    assert pieces_of(held, 128) == [library.encode(t) for t in held]


def test_forgetting_changes_nothing(monkeypatch):
    held = ["".join(random.Random(k).choice("etaoinshrdlu ") for _ in range(300)) for k in range(40)]
    want = pieces_of(held)
    monkeypatch.setattr(sentencepiece_scan, "PAIRS", 50)
    monkeypatch.setattr(word_ids, "REMEMBERED", 20)
    sentencepiece_scan.vocabulary.cache_clear()
    assert pieces_of(held, limit=600) == want


def test_only_one_segmentation_fits():
    """By brute force over all cuts of short words: exactly one has compatible neighbours only."""
    vocabulary = sentencepiece_scan.vocabulary(PIECE)
    place = {vocabulary.pieces[i]: k for k, i in enumerate(vocabulary.ids.tolist())}
    for word in ["▁theatre", "ababab", "▁▁▁▁x", "aaaaaa", "needless"]:
        ways = []
        for mask in range(1 << (len(word) - 1)):
            cuts = [0, *(k + 1 for k in range(len(word) - 1) if mask >> k & 1), len(word)]
            parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
            if all(p in place for p in parts):
                at = np.array([place[p] for p in parts])
                if vocabulary.compatible(at[:-1], at[1:]).all():
                    ways.append(parts)
        assert len(ways) == 1, (word, ways)


def test_scan_is_associative():
    rng = np.random.default_rng(4)
    stack = rng.normal(size=(7, 5, 5))
    want = [stack[0]]
    for m in stack[1:]:
        want.append((want[-1][:, :, None] + m[None, :, :]).max(axis=1))
    assert np.allclose(sentencepiece_scan.prefix_scan(stack), np.stack(want))
    assert np.allclose(sentencepiece_scan.suffix_scan(stack)[0], want[-1]) and np.allclose(sentencepiece_scan.suffix_scan(stack)[-1], stack[-1])


def test_sentencepiece_round_trip(docs):
    encoded = sentencepiece_scan.encode_column(docs, PIECE, keep=("doc_id", "extra"))
    decoded = sentencepiece_scan.decode_column(encoded, PIECE, keep=("doc_id",)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in decoded) == sorted((r[0] or -1, (r[1] or "").replace("▁", " ")) for r in rows())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(empty, BYTE, P.PATTERN).count() == 0
    assert wavelet_store.read_shards(wavelet_store.write_shards(empty, WORD, 2)).count() == 0
    assert packing.pack(empty, WORD).count() == 0
    assert sentencepiece_scan.encode_column(empty, PIECE).count() == 0


def test_queries_on_the_small_tables(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for r in queries.op5_token_counts(spark, small).collect():
        n = len(byte.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 1024)
    ids = {k: word.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    start = 0
    for r in sorted(queries.op6_wavelet_token_store(spark, small).collect(), key=lambda r: r["doc_id"]):
        held = ids[r["doc_id"]] + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(held), crc(held))
        start += len(held)
    check_packing(queries.op10_best_fit_packing(spark, small).collect(), list(docs.items()), 4096, lambda t: word.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in queries.op3_sentencepiece_scan(spark, small).collect():
        held = pieces.encode(docs[r["doc_id"]])
        assert (r["n_pieces"], r["pieces_crc32"], r["round_trip"]) == (len(held), crc(held), True)


def test_decoding_odd_ids(spark):
    """Bytes that are no UTF-8, control and unknown ids, nulls."""
    rows = [(1, [3 + 0xC3]), (2, [1, 0, 2]), (3, None), (4, []), (5, [3 + 0xC3, 3 + 0xA9])]
    found = sentencepiece_scan.decode_column(spark.createDataFrame(rows, "doc_id long, pieces array<int>"), PIECE).collect()
    assert {r["doc_id"]: (r["text"], r["n_pieces"]) for r in found} == {1: ("\ufffd", 1), 2: ("\u2047 ", 3), 3: ("", 0), 4: ("", 0), 5: ("é", 2)}
