"""Near vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, links string, home int"


def brute(rows, cosine=0.95):
    def norm(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    unit = [norm(v) for _, v in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, k, least.get(r), d == least.get(r)) for (d, _), k, r in zip(rows, links, root)), key=str)


def result(spark, rows, **how):
    df = spark.createDataFrame([(d, v, 1, "x", 2) for d, v in rows], SCHEMA)
    return sorted((tuple(r) for r in vectors.near_vectors(df, **how).collect()), key=str)


def corpus(dim=16):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, dim))
    near = [b + rng.normal(size=dim) * s for b in base[:60] for s in (0.05, 0.1, 0.2, 0.3)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near])]
    rows += [(1000 + i, base[0].tolist()) for i in range(80)] + [(2000 + i, (base[1] * (i + 1) + rng.normal(size=dim) * 0.01).tolist()) for i in range(90)]
    nan, inf = [float("nan"), *[1.0] * (dim - 1)], [float("inf"), *[1.0] * (dim - 1)]
    return rows + [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, nan), (3004, inf), (3005, [None, *[1.0] * (dim - 1)]), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, base[5].tolist()), (None, [9.0]), (7, base[9].tolist()), (3008, [1e30] * dim), (3009, [1e-30] * dim)]


@pytest.mark.parametrize(("block", "cells"), [(16, 4096), (1024, 4096), (16, 1)])
def test_links_equal_all_pairs(spark, monkeypatch, block, cells):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "MAX_CELLS", cells)
    rows = corpus()
    assert result(spark, rows, sigmas=math.inf) == brute(rows)


def test_recall_with_the_statistical_margin(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = corpus(64)
    got, want = result(spark, rows), brute(rows)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)


def test_empty_and_unusable(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, [0.0]), (None, None)]) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_pairs_in_few_directions(spark, monkeypatch):
    """Vectors in 3 of 256 dimensions: differences lean on the borders, so a margin narrower than half the chord loses pairs."""
    monkeypatch.setattr(vectors, "BLOCK", 200)
    rng = np.random.default_rng(3)
    plane = np.linalg.qr(rng.normal(size=(256, 3)))[0]
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, 0.955 * x + math.sqrt(1 - 0.955**2) * side]) @ plane.T)]
    assert result(spark, rows) == brute(rows)


def test_what_is_stored_does_not_grow_with_visits(spark, monkeypatch):
    """Vectors without clusters visit most cells; they are stored once in blocks, and nothing is shuffled to compare them."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    kept, stage = {}, vectors.stage
    monkeypatch.setattr(vectors, "stage", lambda df, label: kept.setdefault(label, (df, stage(df, label)))[1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:300] + rng.normal(size=(300, 16)) * 0.05]))]
    assert result(spark, rows) == brute(rows)
    blocks = kept["blocks"][1].collect()
    assert sum(len(r["x"]) for r in blocks) == 1800 * 16 * 4 and len(blocks) > 3
    assert max(len(r["seen"]) for r in blocks) > 10  # many cells, whose visitors are not copied
    plan = kept["links"][0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("hashes", [7, 1 << 40])
def test_vectors_of_one_hash_are_told_apart(spark, monkeypatch, hashes):
    monkeypatch.setattr(vectors, "_key", lambda v: F.pmod(F.xxhash64(v), F.lit(hashes)))
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, -0.0]), *[(10 + i, [math.cos(i), math.sin(i)]) for i in range(30)]]
    assert result(spark, rows) == brute(rows)
