"""Hard negatives against a plain search over all pairs, and the query against its SQL."""

import math
import random
import struct

import duckdb
import pytest

import __spark_entry__ as entry
from ebbtide.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def short(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def plain(rows, every=100, first=5, count=10, low=30, high=90):
    use = [(i, n, [math.floor(256 * x) for x in v], k) for k, (i, v, n) in enumerate(rows) if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v, k in use:
        if i is None or i % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m, n == o) for j, o, w, m in use if m != k and len(w) == len(v)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0, s[2]))
        for p in [s for s in scores if s[3]][:first]:
            fit = [s for s in scores if not s[3] and low * p[0] <= 100 * s[0] <= high * p[0]][:count]
            out += [(i, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def made(seed, n=1200):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        v = [short(rnd.choice([0.0, 0.1, -0.2, 0.35, rnd.random() - 0.4])) for _ in range(rnd.choice([4, 4, 4, 3, 0]))]
        v = {7: [float("nan")], 9: None, 11: [None], 13: [float("inf"), 1.0]}.get(k % 50, v)
        rows.append((rnd.choice([None, rnd.randrange(900) * rnd.choice([1, 1, 10])]), v, rnd.choice([None, 0, 1, 1, 1, 2])))
    return rows


@pytest.mark.parametrize("grid", [(4096, 16384), (5, 100)])
def test_equals_a_plain_search(spark, monkeypatch, grid):
    monkeypatch.setattr(negatives, "ANCHORS", grid[0])
    monkeypatch.setattr(negatives, "ROWS", grid[1])
    rows = made(3)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows) and len(got) > 500


def test_window_of_score_zero_opens_before_its_negatives(spark):
    rows = [(100, [1.0, 0.0], 1), (90, [0.0, 1.0], 1), (5, [0.0, 1.0], 2), (6, [0.0, -1.0], 2)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == [(100, 90, 1, 5, 0, 0), (100, 90, 2, 6, 0, 0)]


def test_hot_label_and_copies(spark):
    rows = [(k, [1.0, short(k % 3 / 10)], 1) for k in range(0, 900)] + [(1000 + k, [0.5, 0.1], 2) for k in range(300)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_empty_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", dim int, ga int, rid string")
    assert negatives.mine(none).columns == COLUMNS and negatives.mine(none).count() == 0
    rows = made(4, 300)
    odd = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", rid int, q string, score int").coalesce(1)
    assert sorted(map(tuple, negatives.mine(odd).collect()), key=str) == plain(rows)


def test_large_components(spark):
    rows = [(0, [3e6, 2e6], 1), (1, [3e6, 1e6], 1), (2, [1e6, 2e6], 2)]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect())) == plain(rows)
    with pytest.raises(Exception, match="too large"):
        negatives.mine(spark.createDataFrame([(0, [3e30], 1), (1, [3e30], 1)], SCHEMA)).collect()


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    name = "op11_hard_negatives"
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = entry.queries()[name](spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(want)
