"""Fitted models and streams: properties instead of fixed rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.config import FEATURE_NAMES, feature_schema_hash
from ebbtide.operators import explain, features, messages, semantics, training
from ebbtide.plans.bindings import Tables
from ebbtide.streaming import jobs


@pytest.fixture(scope="module")
def frame(spark):
    """Feature rows whose label follows recency_days."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        x = rng.normal(size=len(FEATURE_NAMES)).tolist()
        x[FEATURE_NAMES.index("recency_days")] = float(rng.integers(0, 200))
        rows.append((i, dt.date(2024, 1, 1), *x, 3, int(x[FEATURE_NAMES.index("recency_days")] > 170)))
    schema = "customer_id long, as_of_date date, " + ", ".join(f"{n} double" for n in FEATURE_NAMES) + ", trusted_feedback_used long, churned int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def model(frame):
    return training.train_risk_model(frame, trees=5)


def test_model_finds_the_driver(model):
    assert training.feature_importance(model)[0][0] == "recency_days"


def test_a_fit_has_a_part_for_each_core(spark, frame, monkeypatch):
    """Whatever the number of shuffle partitions: a fit runs hundreds of stages, with a task for each part."""
    assert [training.fit_parts(n, 12) for n in (0, 600_000, 6_000_000, 6_000_001, 36_000_000)] == [12, 12, 12, 24, 72]
    seen, cut = [], training.cut_lineage
    monkeypatch.setattr(training, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        training.train_risk_model(frame, trees=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[-1].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shapley_values_add_up(frame, model):
    some = training.neutralize(frame).limit(20).cache()
    explained = explain.shapley_contributions(some, model, "customer_id")
    scored = {r["customer_id"]: r["score"] for r in training.model_scores(model, some).collect()}
    means = some.agg(*[F.avg(n).alias(n) for n in FEATURE_NAMES])
    base = training.model_scores(model, means).first()["score"]
    weight = dict.fromkeys(FEATURE_NAMES, 0.0)
    for r in explained.collect():
        total = sum(c["contribution"] for c in r["contributions"])
        assert total == pytest.approx(scored[r["customer_id"]] - base, abs=1e-9)
        for c in r["contributions"]:
            weight[c["feature"]] += abs(c["contribution"])
    assert max(weight, key=weight.get) == "recency_days" and weight["tenure_days"] == 0


def test_scores_have_floor_label_and_provenance(frame, model):
    info = training.ModelInfo("v", "h")
    rows = training.score_customers(frame.drop("churned"), model, info, dt.datetime(2024, 2, 1)).collect()
    assert len(rows) == 400 and len({r["pred_id"] for r in rows}) == 400
    for r in rows:
        used = dict(zip(FEATURE_NAMES, r["features_used"]))
        assert r["feature_schema_hash"] == feature_schema_hash() and r["model_version"] == "v"
        if used["recency_days"] >= 180 and used["tx_count_90d"] <= 0 and used["spend_90d"] <= 0:
            assert r["churn_score"] >= 0.9 and r["churn_label"] == "high"
    with pytest.raises(ValueError):
        features.check_feature_schema(frame.drop("recency_days"))
    with pytest.raises(ValueError):
        features.check_feature_schema(frame, "other")


def test_oversampling_balances_between_neighbours(frame):
    counts = training.class_weight(frame).first()
    assert training.needs_oversampling(counts["positives"], counts["negatives"])
    out = training.oversample(frame, FEATURE_NAMES)
    made = out.filter("synthetic").collect()
    assert len(made) == counts["negatives"] - counts["positives"]
    real = [r["recency_days"] for r in frame.filter("churned = 1").collect()]
    assert all(min(real) <= r["recency_days"] <= max(real) and r["churned"] == 1 for r in made)
    again = training.oversample(frame, FEATURE_NAMES).filter("synthetic").count()
    assert again == len(made)


def test_median_impute(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (8.0,), (None,), (float("nan"),), (10.0,)], "x double")
    assert sorted(r["x"] for r in training.median_impute(df, df, ("x",)).collect()) == [1.0, 3.0, 5.5, 5.5, 8.0, 10.0]


def test_topics_are_found_and_assigned(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (np.eye(3)[i % 3] + rng.normal(scale=0.05, size=3))]) for i in range(90)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    centroids = semantics.train_topics(df, topics=3, min_size=5)
    got = {r["vec_id"]: (r["topic_idx"], r["similarity"]) for r in semantics.assign_topics(df, centroids, 0.5).collect()}
    assert got[99] == (None, None) and len({got[i][0] for i in range(3)}) == 3
    assert all(got[i][0] == got[i % 3][0] and got[i][1] > 0.9 for i in range(90))
    assert semantics.assign_topics(df, centroids, 1.1).filter("topic_idx = -1").count() == 90


def _stream(spark, frame, folder, column):
    """One file per day in order of time, each its own trigger."""
    import pathlib
    import time

    days = sorted(r[0] for r in frame.select(F.to_date(column)).distinct().collect())
    for i, day in enumerate(days):
        frame.filter(F.to_date(column) == F.lit(day)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    assert len(list(pathlib.Path(folder).glob("*.parquet"))) == len(days)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 5).parquet(folder)


def test_streamed_reply_times_equal_batch(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    talk = t.messages().select("msg_id", F.col("phone_number").cast("bigint").alias("customer_id"), "direction", "timestamp").cache()
    # replies are given out when the watermark passes their hour; a message of nobody, days later, closes the last ones
    end = talk.agg(F.max("timestamp").alias("timestamp")).selectExpr("-1L AS msg_id", "-1L AS customer_id", "'inbound' AS direction", "timestamp + INTERVAL 3 DAYS AS timestamp")
    stream = _stream(spark, talk.unionByName(end), str(tmp_path / "in"), "timestamp")
    out = jobs.run_available(jobs.stream_response_times(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = messages.response_times(talk).filter("response_time_secs IS NOT NULL").select("customer_id", "msg_id", "response_time_secs")
    assert sorted(map(tuple, out.select("customer_id", "msg_id", "response_time_secs").collect())) == sorted(map(tuple, want.collect()))


def test_streamed_dedup_spans_triggers(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    chats = t.chats().select(F.col("phone").alias("phone_number"), "timestamp", "text").cache()
    folder = str(tmp_path / "in")
    chats.coalesce(1).write.mode("append").parquet(folder)
    chats.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(chats.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = jobs.run_available(jobs.stream_ingest_messages(stream, "30 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert out.count() == chats.dropDuplicates().count()


def test_streamed_counts_equal_batch_for_closed_days(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    talk = t.messages().select(F.col("phone_number").cast("bigint").alias("customer_id"), "timestamp").cache()
    out = jobs.run_available(jobs.stream_message_counts(_stream(spark, talk, str(tmp_path / "in"), "timestamp")), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["customer_id"], r["day"]): r["messages"] for r in out.collect()}
    want = {(r[0], r[1]): r[2] for r in talk.groupBy("customer_id", F.to_date("timestamp")).count().collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = max(d for _, d in want)
    assert set(k for k in want if k[1] < last - dt.timedelta(1)) <= set(got)


def test_signals_of_messages_linked_later(spark, tmp_path):
    schema, texts, links, out = "msg_id long, text string", tmp_path / "texts", str(tmp_path / "links"), str(tmp_path / "out")
    link_schema = "msg_id long, link_id long, customer_id long, match_confidence double"
    add = lambda rows, s, path: spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(path))
    said = [(i, f"refund {i}!" if i % 2 else f"hello {i}?") for i in range(12)]
    known = [(i, 10 * i, i % 3, 1.0 if i != 5 else 0.2) for i in range(10)]

    def trigger():
        stream = spark.readStream.schema(schema).parquet(str(texts))
        sink = jobs.link_and_append(out, lambda: spark.read.schema(link_schema).parquet(links))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    for part, at in ((said[:6], known[:2]), (said[6:9], known[2:8]), (said[9:], known[8:])):
        add(part, schema, texts)
        add(at, link_schema, links)
        trigger()
    got = spark.read.parquet(f"{out}/rows").drop("batch")
    want = jobs.stream_message_features(spark.createDataFrame(said, schema), spark.createDataFrame(known, link_schema))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 9


def test_ablation_measures_the_loss_of_the_driver(frame, model):
    """The full model is taken as it is; without the feature that the label follows the area falls."""
    out = training.ablation_auc(frame, frame, ("recency_days", "recency_ratio"), trees=5, full=model).first()
    y = {r["customer_id"]: (r["churned"], r["score"]) for r in training.model_scores(model, frame).collect()}
    ones, zeros = [s for c, s in y.values() if c == 1], [s for c, s in y.values() if c == 0]
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert out["full"] == pytest.approx(area, abs=1e-4) and out["reduced"] < out["full"]
    assert out["drop_percent"] == pytest.approx((out["full"] - out["reduced"]) * 100 / out["full"])


def test_the_encoder_counts_signed_words(spark):
    rows = spark.createDataFrame([(1, "late again late"), (2, "LATE late  again"), (3, "other"), (4, "  "), (5, None)], "msg_id long, text string")
    got = {r["msg_id"]: r["embedding"] for r in messages.embed_messages(rows).collect()}
    assert got[1] == got[2] and got[4] is None and got[5] is None
    late, again = (messages.hashing_encoder()([w])[0] for w in ("late", "again"))
    both = 2 * late + again
    assert np.allclose(got[1], both / np.linalg.norm(both), atol=1e-6) and np.isclose(np.linalg.norm(got[3]), 1.0)


def test_topic_centroids_are_the_means_of_their_members(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.eye(4)[i % 4] * 3 + rng.normal(scale=0.2, size=4)]) for i in range(120)] + [(500, [-1.0, -1.0, -1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    centroids = {r["topic_idx"]: r for r in semantics.train_topics(df, topics=5, min_size=5).collect()}
    near = {}
    for r in semantics.assign_topics(df.filter("vec_id < 500"), spark.createDataFrame(list(centroids.values())), -1.0).collect():
        near.setdefault(r["topic_idx"], []).append(r["embedding"])
    assert sorted(r["size"] for r in centroids.values()) == [30, 30, 30, 30]
    for k, members in near.items():
        unit = np.array([m / np.linalg.norm(m) for m in np.array(members)])
        mean, centre = unit.mean(0) / np.linalg.norm(unit.mean(0)), np.array(centroids[k]["centroid"])
        assert np.allclose(mean, centre / np.linalg.norm(centre), atol=1e-3)
