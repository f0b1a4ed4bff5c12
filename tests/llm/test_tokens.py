"""Token files: exact round trips, codes within their limit, whole-text encoding."""

import heapq
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ebbtide.llm import huffman, tokens

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "hello world", "hello  world", "line one\nline two\n\n three", "tab\t here", "it's we'll they'd'", "x y  z", "a \n b", "\n lead", "trail \n",
    "Ünïcödé straße 東京 🙂 🙂🙂", "<|endoftext|> is text", "nul\x00byte \x1c sep", "1234 567,89 %$# !!", "don't  stop   now    ok", " em  space", "é combining", "'s 's", "x" * 5000, "word " * 30_000,
]


@pytest.fixture(scope="module")
def definition():
    with open(tokens.vocabulary_file(), encoding="utf-8") as f:
        return f.read()


def test_parts_of_a_text_give_the_ids_of_the_text(definition):
    library = Tokenizer.from_str(definition)
    rng = random.Random(1)
    bits = ["a", "Bc", "é", " ", "  ", "\n", "\t", "'s", "9", "!", " ", "東", "​", "\x1d", "..."]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for keep in (10, 10_000):
        enc = tokens.Encoder(definition, keep)
        for at in range(0, len(texts), 100):
            got = enc.encode(texts[at : at + 100])
            assert [np.frombuffer(g, enc.kind).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 100]]


@pytest.mark.parametrize("limit", [5, 9, 18])
def test_codes_are_prefix_free_limited_and_short(limit):
    rng = np.random.default_rng(limit)
    counts = (rng.pareto(0.6, 24) * 10).astype(np.int64) + 1
    counts[[3, 9]] = 0
    lengths = huffman.code_lengths(counts, limit)
    used = np.flatnonzero(counts)
    assert (lengths[used] > 0).all() and lengths.max() <= limit and not lengths[[3, 9]].any()
    assert sum(2.0 ** -int(n) for n in lengths[used]) <= 1
    codes = [f"{int(c):0{int(n)}b}" for c, n in zip(huffman.canonical(lengths)[used], lengths[used])]
    assert not [1 for a in codes for b in codes if a != b and b.startswith(a)]
    heap, total = counts[used].tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    spent = int((counts * lengths).sum())
    assert spent == total if limit == 18 else spent >= total


@pytest.mark.parametrize("kinds", [0, 1, 2, 3000])
def test_round_trip_of_bits(kinds):
    rng = np.random.default_rng(kinds)
    sizes = np.array([0, 1, 5000, 0, 1024, 1025, 3] if kinds else [0, 0])
    ids = (rng.zipf(1.3, int(sizes.sum())) % max(1, kinds)).astype(np.int64)
    counts = np.bincount(ids, minlength=max(1, kinds))
    lengths = huffman.code_lengths(counts)
    payload, used, marks = huffman.encode(ids, sizes, lengths, huffman.canonical(lengths))
    base = np.concatenate(([0], np.cumsum(used)))[:-1] * 8
    runs = np.concatenate([np.minimum(huffman.STEP, n - np.arange(0, n, huffman.STEP)) for n in sizes]).astype(np.int64)
    starts = np.concatenate([m + b for m, b in zip(marks, base)]).astype(np.int64)
    assert huffman.Decoder(lengths).decode(payload, starts, runs).tolist() == ids.tolist()


def test_stored_tokens_equal_the_library(spark, definition, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 64)
    library = Tokenizer.from_str(definition)
    rng = random.Random(2)
    rows = [(i * 3 % 101, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "none either"), (5, "twice"), (5, "twice")]
    rows += [(rng.randrange(-50, 1000), f"text {i} of many") for i in range(200)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, n int").repartition(6)
    got = [tuple(r) for r in tokens.stored_tokens(df).select("start", "doc_id", "n_tokens", "ids_crc32").collect()]
    assert len(got) == len(rows)
    got.sort()
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [d for _, d, _, _ in got]
    assert ids == sorted((d for d in ids if d is not None)) + [None, None]
    want = sorted(((d, len(e) + 1, zlib.crc32(np.array([*e, 0], "<u4").tobytes())) for d, t in rows for e in [library.encode(t or "", add_special_tokens=False).ids]), key=str)
    assert sorted(((d, n, c) for _, d, n, c in got), key=str) == want


def test_empty_table(spark):
    assert tokens.stored_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
