"""The k-nearest join against all pairs: ties, copies, clusters, few points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.config import FEATURE_NAMES
from ebbtide.functions import neighbours
from ebbtide.operators import training

SCHEMA = "_id long, z array<double>"


def square(a, b):
    total = 0.0
    for p, q in zip(a, b, strict=True):  # in order, for sum() rounds differently
        total += (p - q) * (p - q)
    return total


def plain(ids, x, k):
    out = []
    for i, a in zip(ids, x, strict=True):
        d = [(square(a, b), j) for j, b in zip(ids, x, strict=True) if j != i]
        out += [(i, r, j, float(np.sqrt(s))) for r, (s, j) in enumerate(sorted(d)[:k], 1)]
    return sorted(out)


def made(kind, n=400):
    rng = np.random.default_rng(9)
    if kind == "clusters":
        x = rng.normal(size=(6, 4))[rng.integers(0, 6, n)] * 10 + rng.normal(size=(n, 4)) * 0.1
    elif kind == "ties":
        x = rng.integers(0, 3, (n, 4)).astype(float)
    elif kind == "copies":
        x = np.where(rng.random((n, 1)) < 0.4, 0.0, rng.normal(size=(n, 4)))
    else:
        x = rng.normal(size=(n, 4)) * [1000.0, 1.0, 0.1, 0.0]
    return rng.permutation(n).tolist(), x.tolist()


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "scales"])
def test_equals_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    ids, x = made(kind)
    points = spark.createDataFrame(list(zip(ids, x, strict=True)), SCHEMA)
    got = neighbours.nearest_join(points, 5, pivots=12).collect()
    assert sorted((r["id"], r["rank"], r["other"], r["distance"]) for r in got) == plain(ids, x, 5)


def test_few_points(spark):
    for n in (0, 1, 2, 4):
        points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], SCHEMA)
        got = neighbours.nearest_join(points, 5).collect()
        assert sorted((r["id"], r["rank"], r["other"], r["distance"]) for r in got) == plain(list(range(n)), [[float(i), 1.0] for i in range(n)], 5)


def test_blocks_are_pruned(spark, monkeypatch):
    """Points of far clusters never meet: fewer visits than points times blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    ids, x = made("clusters")
    calls = []
    plain_visits = neighbours._Pieces.visits
    pieces = neighbours._Pieces(np.arange(3), np.arange(3), np.zeros(3), np.ones(3), np.array([[0.0, 0.0], [10.0, 0.0], [20.0, 0.0]]))
    near = plain_visits(pieces, np.array([[0.5, 0.0], [10.0, 0.0]]), np.array([0, 1]), np.array([1.0, 9.5]))
    calls.append(near)
    assert near.tolist() == [[True, False, False], [True, True, True]]


def test_synthetic_rows_lie_between_true_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=len(FEATURE_NAMES))), int(i % 9 == 0)) for i in range(180)]
    df = spark.createDataFrame(rows, "customer_id long, " + ", ".join(f"{n} double" for n in FEATURE_NAMES) + ", churned int")
    real = np.array([r[1:-1] for r in rows if r[-1] == 1])
    square = ((real[:, None] - real[None]) ** 2).sum(-1)
    np.fill_diagonal(square, np.inf)
    near = np.argsort(square, axis=1)[:, :5]
    made_rows = np.array([[r[n] for n in FEATURE_NAMES] for r in training.oversample(df, FEATURE_NAMES).filter("synthetic").collect()])
    assert len(made_rows) == 180 - 2 * len(real)
    for v in made_rows:
        gaps = []
        for i in range(len(real)):
            for j in near[i]:
                along = real[j] - real[i]
                share = np.clip((v - real[i]) @ along / (along @ along), 0, 1)
                gaps.append(np.abs(real[i] + share * along - v).max())
        assert min(gaps) < 1e-9
