"""Ids against the library for every text, and the bytes given back from the ids alone."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken

from ebbtide.llm import bpe, pieces, queries

SCHEMA = "doc_id long, text string"
LETTERS = " \n\t 'stmdrevl'a1,.é中\x1c\x85  ' <|endoftext|>\U0001f600\x00'S½٣"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return texts + ["", " ", "  ", "\n", "it's'll", "''s", " 's", "x 're", "a" * 5000, " " * 5000, "don't " * 5000]


def test_words_equal_the_pattern():
    texts = odd_texts()
    words, counts = pieces.pretokens(texts)
    want = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert [w.decode() for w in words.to_pylist()] == [w for x in want for w in x]
    assert counts.tolist() == [len(x) for x in want]


def test_slices_do_not_change_words(monkeypatch):
    texts = odd_texts(300) + ["word  two\n three " * 50]
    whole = pieces.pretokens(texts)[0].to_pylist()
    monkeypatch.setattr(pieces, "SLICE_CHARS", 7)
    words, counts = pieces.pretokens(texts)
    assert words.to_pylist() == whole and counts.sum() == len(whole)


def test_every_code_point_is_classed_as_the_library_does():
    """Between two letters, a code point makes one word, two or three: the same by both."""
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    codes = [c for c in range(0x1FFFF) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a 1{chr(c)}" for c in codes]
    counts = pieces.pretokens(texts)[1].tolist()
    assert counts == [len(library.pre_tokenize_str(t)) for t in texts]


@pytest.mark.parametrize("block", [8 << 20, 500])
def test_equals_the_library_and_round_trips(spark, ranks, library, monkeypatch, block):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", block)
    rows = [(k if k % 7 else None, t) for k, t in enumerate([*odd_texts(), None, None])] + [(1, "same"), (1, "same")]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA), ranks), ranks).drop("_rid").collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert sorted([(r[0], r[1], bytes(r[2]), bytes(r[3])) for r in got], key=str) == sorted(want, key=str)


def test_empty_table_and_clashing_columns(spark, ranks, library):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(none.select("doc_id", "text")).count() == 0
    odd = spark.createDataFrame([(5, "some words", 1, "x", b"y")], SCHEMA + ", _rid long, block string, ids binary")
    found = bpe.encode(odd, ranks).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in found] == [library.encode_ordinary("some words")]
    named = spark.createDataFrame([("k", "some words")], "doc_id string, text string")
    assert bpe.encode(named, ranks).first()["doc_id"] == "k"


def test_decode_refuses_unknown_ids_and_keeps_nulls(spark, ranks):
    rows = spark.createDataFrame([(None, "x"), (b"", "y")], "ids binary, decoded string")
    assert [r["decoded"] for r in bpe.decode(rows, ranks).collect()] == [None, b""]
    with pytest.raises(Exception, match="no bytes"):
        bpe.decode(spark.createDataFrame([(b"\xff\xff\xff\xff",)], "ids binary"), {b"a": 0}).collect()


def test_query_equals_the_library(spark, sf_dir, documents, library):
    got = {r["doc_id"]: tuple(r) for r in queries.op12_bpe(spark, sf_dir).collect()}
    for r in documents.select("doc_id", "text").collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        assert got.pop(r["doc_id"]) == (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got
