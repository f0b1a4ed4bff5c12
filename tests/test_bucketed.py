"""Stored parts in buckets: joined without a shuffle, upserted in one commit."""

import datetime as dt

import pytest

from ebbtide.operators import stored
from ebbtide.plans.bindings import DENSE, Tables
from ebbtide.sources import bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_stored_parts_need_no_exchange(spark, sf_dir, tmp_path):
    t, root = Tables(spark, sf_dir), str(tmp_path / "parts")
    at = t.anchor("events")
    stored.store_vector_inputs(root, t.customers(), t.purchases(), t.trusted(), t.semantics(), at, DENSE, prior_days=10, buckets=8)
    found = stored.stored_feature_vector(spark, root, at, DENSE)
    text = plan(found)
    assert "Exchange" not in text and text.count("SortMergeJoin") == 4 and "Bucketed: true" in text
    assert found.count() == t.customers().count()


def test_upsert_by_key_in_one_commit(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path / "b"), "customer_id long, v int"
    a = lambda rows: spark.createDataFrame(rows, schema)
    bucketed.write_bucketed(spark, root, {"x": a([(1, 1), (2, 2)]), "y": a([(1, 9)])}, "2024-01-01", buckets=4)
    bucketed.write_bucketed(spark, root, {"x": a([(2, 5), (3, 3)])}, "2024-01-01", buckets=4)
    bucketed.write_bucketed(spark, root, {"x": a([(7, 7)])}, "2024-01-02", buckets=4)
    read = lambda n, d: sorted(map(tuple, bucketed.read_bucketed(spark, root, n, d).collect()))
    assert read("x", "2024-01-01") == [(1, 1), (2, 5), (3, 3)] and read("x", "2024-01-02") == [(7, 7)] and read("y", "2024-01-01") == [(1, 9)]
    monkeypatch.setattr(bucketed.catalog, "publish", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        bucketed.write_bucketed(spark, root, {"x": a([(1, 100)]), "y": a([(1, 100)])}, "2024-01-01", buckets=4)
    assert read("x", "2024-01-01") == [(1, 1), (2, 5), (3, 3)] and read("y", "2024-01-01") == [(1, 9)]


def test_dates_of_other_bucket_numbers_still_join(spark, tmp_path):
    root = str(tmp_path / "b")
    rows = spark.range(50).selectExpr("id AS customer_id", "id * 2 AS v")
    bucketed.write_bucketed(spark, root, {"x": rows}, dt.date(2024, 1, 1).isoformat(), buckets=4)
    bucketed.write_bucketed(spark, root, {"y": rows.withColumnRenamed("v", "w")}, "2024-01-01", buckets=8)
    assert bucketed.joined(spark, root, ["x", "y"], "2024-01-01").filter("v = w").count() == 50
