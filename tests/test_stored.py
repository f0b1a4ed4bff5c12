"""Jobs that store what they make: upserts, one active version, what is kept when a job runs again."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ebbtide.config import FEATURE_NAMES
from ebbtide.operators import stored, training
from ebbtide.sources.imports import stored as table

NOW = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def dataset(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        x = rng.normal(size=len(FEATURE_NAMES)).tolist()
        rows.append((f"c{i:04d}", dt.date(2024, 1 + i % 4, 1), *x, int(x[0] + 0.3 * x[5] > 0.8)))
    return spark.createDataFrame(rows, "customer_id string, observation_date date, " + ", ".join(f"{n} double" for n in FEATURE_NAMES) + ", churned int").cache()


def test_retraining_is_stored_and_one_version_is_active(spark, dataset, tmp_path):
    path = str(tmp_path / "models")
    first = stored.retrain_and_store(dataset, path, "v1", NOW, trees=3)
    want = {r["metric"]: tuple(r) for r in training.retrain(dataset, trees=3, version="v1").collect()}
    assert {r["metric"]: tuple(r) for r in first.collect()} == want
    stored.retrain_and_store(dataset, path, "v2", NOW + dt.timedelta(1), trees=2)
    stored.retrain_and_store(dataset, path, "v2", NOW + dt.timedelta(2), trees=2)
    versions = {r["model_version"]: r for r in table(spark, f"{path}/versions").collect()}
    assert {k: r["is_active"] for k, r in versions.items()} == {"v1": False, "v2": True}
    assert versions["v2"]["training_date"] == NOW + dt.timedelta(2) and versions["v1"]["model_hash"] != versions["v2"]["model_hash"]
    assert [r["model_version"] for r in stored.active_model(spark, path).collect()] == ["v2"]
    metrics = table(spark, f"{path}/metrics").collect()
    assert sorted((r["model_version"], r["model"]) for r in metrics) == [("v1", "baseline"), ("v1", "multimodal"), ("v2", "baseline"), ("v2", "multimodal")]
    assert all(r["train_size"] + 0 >= 192 and r["test_size"] == 48 for r in metrics)
    compared = table(spark, f"{path}/comparison").filter("model_version = 'v1'").collect()
    assert {r["metric"]: r["improvement"] for r in compared} == {k: v[3] for k, v in want.items()} and "ROC-AUC" in compared[0]["interpretation"]
    model = PipelineModel.load(versions["v2"]["model_path"])
    assert training.model_scores(model, dataset).count() == 240


def test_topics_keep_their_first_time_and_can_be_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "topics"), "topic_idx int, top_keywords array<string>"
    stored.store_topics(spark.createDataFrame([(0, ["late", "", None]), (1, ["soap"])], schema), path, "m1", NOW)
    stored.store_topics(spark.createDataFrame([(0, ["x"])], schema), path, "m2", NOW)
    out = stored.store_topics(spark.createDataFrame([(1, ["price"]), (2, ["soft"])], schema), path, "m1", NOW + dt.timedelta(1))
    got = {r["topic_idx"]: (r["top_keywords"], r["created_at"], r["updated_at"]) for r in out.collect()}
    assert got == {0: (["late"], NOW, NOW), 1: (["price"], NOW, NOW + dt.timedelta(1)), 2: (["soft"], NOW + dt.timedelta(1), NOW + dt.timedelta(1))}
    out = stored.store_topics(spark.createDataFrame([(1, ["clean"])], schema), path, "m1", NOW + dt.timedelta(2), replace=True)
    assert [(r["topic_idx"], r["created_at"]) for r in out.collect()] == [(1, NOW)]
    assert table(spark, path).filter("model_version = 'm2'").count() == 1


def test_explanations_are_replaced_by_prediction(spark, tmp_path):
    path = str(tmp_path / "why")
    rows = spark.range(50).select(F.col("id").alias("pred_id"), F.lit("v1").alias("explainer_version"))
    stored.store_explanations(rows, path)
    out = stored.store_explanations(rows.filter("pred_id < 7").withColumn("explainer_version", F.lit("v2")), path)
    assert {r["pred_id"]: r["explainer_version"] for r in out.collect()} == {k: "v2" if k < 7 else "v1" for k in range(50)}
