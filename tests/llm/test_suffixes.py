"""Repeated byte windows against a count of all windows."""

import collections
import hashlib
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import suffixes

SCHEMA = "doc_id long, text string, listed string, kept string"


def brute(rows, n=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared, longer = text(450), text(1500)
    rows = [(i, text(rng.randrange(0, 900))) for i in range(20)]
    rows += [(100 + i, text(rng.randrange(0, 300)) + shared + text(rng.randrange(0, 300))) for i in range(12)]
    rows += [(200 + i, longer[i * 37 :] + text(50) + longer[: 600 + i]) for i in range(8)]
    rows += [(300, "a" * 399), (301, "a" * 399), (302, "a" * 400), (303, "a" * 401), (304, "ab" * 700), (305, text(30) * 20)]
    rows += [(400, longer), (400, longer), (None, longer), (401, None), (402, ""), (None, None), (403, shared[:399] + "#"), (404, "b" + shared[:399])]
    return rows


@pytest.mark.parametrize("group", [2, 4096])
def test_equals_a_count_of_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)  # 2: digits of many runs take the way over rows
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)
    got = suffixes.without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("often", [1, 3, 1000])
def test_frequent_and_other_runs_give_the_same(spark, monkeypatch, often):
    monkeypatch.setattr(suffixes, "OFTEN", often)  # 1: none is looked up in a broadcast
    rows = corpus()
    rows += [(500 + i, rows[20][1]) for i in range(60)]
    got = suffixes.without_repeats(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_a_very_frequent_run_stays_where_it_is(spark):
    rows = spark.range(0, 40_000, 1, 8).selectExpr("id", "IF(id % 10 < 9, 7, id % 1000) AS digit", "IF(id % 10 < 9, 7, id % 8000) AS run")
    counted = rows.groupBy("digit", "run").agg(F.count(F.lit(1)).alias("_n")).filter("digit < 800")
    got = suffixes._repeated(rows, counted, ["digit", "run"]).withColumn("part", F.spark_partition_id()).cache()
    want = [r.id for r in rows.filter("digit < 800").collect()]
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert got.filter("digit = 7").groupBy("part").count().agg(F.max("count")).first()[0] == 36_000 / 8


def test_pieces_of_long_texts_meet(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    data = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000)).encode()
    whole = suffixes.runs(data)
    assert sorted(set(range(len(data) - 399))) == sorted(p for a, near, far in zip(*whole[:3]) for p in range(a - far, a - near + 1))


def test_empty_table(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_radix_passes_by_bytes_equal_a_plain_comparison():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 3, 1200).astype(np.uint8)
    data = np.concatenate([base, base[100:700], rng.integers(0, 3, 500).astype(np.uint8), base[300:900], [base[899] + 1]]).astype(np.uint8)
    data[1500] ^= 1
    pos = rng.choice(len(data) - suffixes.WINDOW, 900, replace=False)
    pos = np.concatenate([pos, pos[:100] + 0])
    cell = rng.integers(0, 2, len(pos))
    got = suffixes.equal_windows(data, pos, cell)
    texts = [(int(c), data[p : p + suffixes.WINDOW].tobytes()) for p, c in zip(pos, cell, strict=True)]
    want = [texts.count(t) > 1 for t in texts]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    assert suffixes.equal_windows(data, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
