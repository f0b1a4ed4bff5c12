"""The stored vector index against a full scan: same rows in the same order, and only some cells read."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import search

SCHEMA = "feature_id long, embedding array<float>, link_status string, processed_at timestamp_ntz, msg_id long, link_id long, customer_id long"
AT = dt.datetime(2024, 1, 1)


def made(kind, n=900):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * 0.05
    elif kind == "copies":
        x = np.where(rng.random((n, 1)) < 0.35, 1.0, rng.normal(size=(n, 8)))
    else:
        x = rng.normal(size=(n, 8))
    rows = [(i, [float(v) for v in r], "verified" if i % 3 else "rejected", AT + dt.timedelta(days=i % 50), i, i, i % 7) for i, r in enumerate(x)]
    return rows + [(n, [0.0] * 8, "verified", AT, n, n, 1), (n + 1, [1.0, 2.0], "verified", AT, n + 1, n + 1, 1), (n + 2, None, "verified", AT, n + 2, n + 2, 1)]


@pytest.fixture(scope="module", params=["clusters", "copies", "even"])
def index(spark, tmp_path_factory, request):
    rows = spark.createDataFrame(made(request.param), SCHEMA).cache()
    path = str(tmp_path_factory.mktemp("index") / request.param)
    search.build_vector_index(rows, path, cells=20, file_rows=100)
    return request.param, rows, path


def scan(rows, query, n, where=None):
    kept = rows.filter("embedding IS NOT NULL").filter(where) if where is not None else rows.filter("embedding IS NOT NULL")
    return [(r["feature_id"], r["s"]) for r in kept.withColumn("s", search.similarity(F.col("embedding"), query)).orderBy(F.desc("s"), "feature_id").limit(n).collect()]


@pytest.mark.parametrize("n", [1, 10, 5000])
def test_equals_the_full_scan(spark, index, n):
    kind, rows, path = index
    rng = np.random.default_rng(8)
    for query in (rows.first()["embedding"], [1.0] * 8, rng.normal(size=8).tolist(), [0.0] * 8):
        found, reading = search.search_index(spark, path, query, n)
        got = found.orderBy("rank").collect()
        assert [(r["feature_id"], r["similarity"]) for r in got] == scan(rows, query, n)
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and reading.cells <= reading.all_cells
        if kind == "clusters" and n < 100 and query is not None and any(query) and query != [1.0] * 8:
            assert reading.rows < reading.all_rows


def test_few_cells_are_read_for_a_vector_of_a_cluster(spark, index):
    kind, rows, path = index
    _, reading = search.search_index(spark, path, rows.first()["embedding"], 5)
    if kind == "clusters":
        assert reading.cells <= 4 and reading.rows < reading.all_rows / 2


def test_filters_hold_inside_the_search(spark, index):
    _, rows, path = index
    where = (F.col("link_status") == "verified") & (F.col("processed_at") <= F.lit(AT + dt.timedelta(days=2)))
    query = rows.first()["embedding"]
    found, _ = search.search_index(spark, path, query, 8, where)
    assert [(r["feature_id"], r["similarity"]) for r in found.orderBy("rank").collect()] == scan(rows, query, 8, where)
    none, reading = search.search_index(spark, path, query, 8, F.lit(False))
    assert none.count() == 0 and reading.cells == reading.all_cells


def test_rows_are_stored_once_and_in_order(spark, index):
    _, rows, path = index
    stored = spark.read.parquet(f"{path}/vectors")
    assert stored.count() == rows.filter("embedding IS NOT NULL").count()
    assert sorted(r[0] for r in stored.select("feature_id").collect()) == sorted(r[0] for r in rows.filter("embedding IS NOT NULL").select("feature_id").collect())
    assert stored.filter("cell = -1").count() == 2


def test_cells_and_rings_are_pruned_by_the_files(spark, index):
    _, _, path = index
    part = spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin([1, 2]) & F.col("angle").between(0.1, 0.2))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters")[1][:80] and "GreaterThanOrEqual(angle" in plan


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "none")
    search.build_vector_index(spark.createDataFrame([], SCHEMA), path)
    found, reading = search.search_index(spark, path, [1.0], 3)
    assert found.count() == 0 and reading.all_rows == 0
