"""Groups and links of two tokenizers against a plain walk over the tokens of the libraries."""

import collections
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from ebbtide.llm import alignment, pieces, queries

SCHEMA = "doc_id long, text string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
LETTERS = " \n\t 'stmdrevl'a1,.é中\x1c\x85  ' <|endoftext|><s></s>\U0001f600\x00▁"


def ends(tokens):
    out, at = {}, 0
    for k, t in enumerate(tokens):
        at += len(t)
        out[at] = k
    return out


def plain(rows):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, docs = pieces.byte_letters(), []
    for i, t in rows:
        groups, links, a, b = [], [], [], []
        if t:
            a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
            left = [bytes(letters[c] for c in first.id_to_token(x)) for x in a]
            right = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(left) == b"".join(right) == (" " + t).encode():
                one, two, p, q = ends(left), ends(right), 0, 0
                for c in sorted(set(one) & set(two)):
                    groups.append(",".join(map(str, a[p : one[c] + 1])) + "|" + ",".join(map(str, b[q : two[c] + 1])))
                    links.append((a[one[c]], b[two[c]]))
                    p, q = one[c] + 1, two[c] + 1
            else:
                a, b = [], []
        docs.append((i, a, b, groups, links))
    count = collections.Counter(x for d in docs for x in d[4])
    most = collections.defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(
        [(i, len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, x in docs],
        key=str,
    )


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_equals_a_plain_walk(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", None, " ", "  ", "a" * 3000, " " * 3000, "don't " * 3000, "<|endoftext|>", "<s> x </s>"]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, "same"), (1, "same")]
    got = found(alignment.aligned(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and sum(r[1] > 0 for r in got) > 1000


def test_groups_as_text(spark):
    rows = [(1, "An example, naïvely tokenised 中"), (2, ""), (3, None)]
    for r in alignment.aligned(spark.createDataFrame(rows, SCHEMA), texts=True).collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        assert r["n_groups"] == (len(r["groups"].split(";")) if r["groups"] else 0)


def test_coalescing_of_intervals_with_gaps_and_nesting():
    a, b = np.array([[0, 4], [4, 6], [6, 9], [12, 13]]), np.array([[0, 6], [6, 7], [7, 9], [10, 12], [12, 13]])
    left, right = alignment.coalesce(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    assert left.tolist() == [0, 0, 1, 3] and right.tolist() == [0, 1, 1, 2, 3]
    i, j = alignment.overlaps(np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 1]), np.array([1, 6]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 1)]


def test_empty_table_other_ids_and_clashing_columns(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([("k", "some words", 1, 2)], "doc_id string, text string, _rid long, block int")
    row = alignment.aligned(odd).first()
    assert row["doc_id"] == "k" and row["n_groups"] == row["n_links"] == row["n_best"] > 0


def test_query_equals_a_plain_walk(spark, sf_dir, documents):
    assert found(queries.op13_alignment(spark, sf_dir)) == plain([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
