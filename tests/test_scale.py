"""Hot keys, exact ranks, leak safety and the shape of plans."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.config import FeatureConfig
from ebbtide.functions import ranking, series, skew
from ebbtide.operators import evaluation, features, training
from ebbtide.plans.bindings import DENSE, Tables
from ebbtide.session import shared_folder
from ebbtide.sources.chat_export import parse_chat_export, read_export_lines
from ebbtide.sources.imports import read_import_csv, write_snapshot


def hot_frame(spark):
    """A third of the rows on one key."""
    rows = [(i, 7 if i % 3 == 0 else i % 50) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k long")


def test_hot_keys_are_found_and_bounded(spark):
    assert [r[0] for r in skew.hot_keys(hot_frame(spark), ["k"], 0.1).collect()] == [7]
    assert skew.hot_keys(hot_frame(spark), ["k"], 0.01).count() < 100


def test_salted_join_equals_join_and_spreads(spark):
    big = hot_frame(spark)
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.salted_join(big, small, ["k"], ["id"], salts=8)
    assert sorted(got.select("id", "v").collect()) == sorted(big.join(small, "k").select("id", "v").collect())
    left = skew.salted_join(big, small.filter("k > 20"), ["k"], ["id"], how="left", salts=8)
    assert left.count() == big.count()


def test_mark_first_matches_window(spark):
    df = hot_frame(spark).withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k")))
    marked = skew.mark_first(df, ["k"], "id", "first")
    want = {}
    for r in df.orderBy("id").collect():
        if r["k"] is not None:
            want.setdefault(r["k"], r["id"])
    assert sorted(r["id"] for r in marked.filter("first").collect()) == sorted(want.values())
    assert marked.count() == df.count()


def test_top_n_trims_before_the_shuffle(spark):
    plan = skew.top_n(hot_frame(spark), ["k"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_global_position(spark):
    rng = random.Random(1)
    names = [f"n{rng.random()}" for _ in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(5)
    got = {r["n"]: r["position"] for r in ranking.global_position(df, ["n"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=301), "b": np.repeat([1.0, 1.0, 1.0, 2.0], 60), "c": np.array([3.5])}
    rows = [(k, float(v)) for k, xs in data.items() for v in xs] + [("a", None)]
    got = ranking.exact_quantiles(spark.createDataFrame(rows, "feature string, value double"), "feature", "value", [0.0, 0.25, 0.5, 0.9, 1.0])
    for r in got.collect():
        assert r["quantile"] == pytest.approx(float(np.quantile(data[r["feature"]], r["prob"])))


def test_running_totals(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(1000)], "x double, n long")
    got = {r["x"]: (r["cum_n"], r["all_n"]) for r in ranking.cumulative(df, "x", ["n"]).collect()}
    run = 0
    for i in range(1000):
        run += i % 3
        assert got[float(i)] == (run, 999)


def test_metrics_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    row = evaluation.classification_metrics(spark.createDataFrame(rows, "y int, score double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        recall = tp / len(pos)
        ap, last = ap + (recall - last) * tp / (tp + fp), recall
    assert row["roc_auc"] == round(auc, 4) and row["pr_auc"] == round(ap, 4)
    one_class = evaluation.classification_metrics(spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")).first()
    assert (one_class["roc_auc"], one_class["pr_auc"], one_class["recall"]) == (0.0, 0.0, 0.5)


def test_time_split_is_the_global_order(spark):
    rng = random.Random(4)
    rows = [(dt.date(2024, m, 1), f"c{c:03d}") for m in range(1, 5) for c in rng.sample(range(100), 23)]
    df = spark.createDataFrame(rows, "observation_date date, customer_id string").repartition(6)
    cut = int(len(rows) * 0.8)
    got = sorted((r[0], r[1]) for r in training.time_split(df).filter("is_train").select("observation_date", "customer_id").collect())
    assert got == sorted(rows)[:cut]


def test_series_properties(spark):
    rng = random.Random(9)
    cfg = FeatureConfig()
    rows = [([float(rng.randrange(0, 50)) for _ in range(rng.randrange(2, 9))],) for _ in range(60)] + [([4.0] * 5,)]
    df = spark.createDataFrame(rows, "x array<double>")
    for r in df.select("x", series.sma(F.col("x"), 1).alias("same"), series.trend_slope(F.col("x")).alias("slope"), series.std_pop(F.col("x")).alias("std"), series.capped_cv(F.col("x"), cfg).alias("cv")).collect():
        x = np.array(r["x"])
        assert r["same"] == r["x"]
        assert r["slope"] == pytest.approx(np.polyfit(np.arange(len(x)), x, 1)[0], abs=1e-9)
        assert r["std"] == pytest.approx(x.std(), abs=1e-9)
        assert 0 <= r["cv"] <= cfg.cv_cap


def test_later_rows_never_change_earlier_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    day = dt.date(2024, 1, 15)
    cut = F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz")

    def vector(purchases, trusted, semantics):
        rows = features.feature_vector(t.customers(), purchases, trusted, semantics, [day], DENSE, prior_days=5)
        return sorted(tuple(r) for r in rows.collect())

    full = vector(t.purchases(), t.trusted(), t.semantics())
    past = vector(t.purchases().filter(F.col("tx_date") < cut), t.trusted().filter(F.col("timestamp") < cut), t.semantics().filter(F.col("as_of_date") <= F.lit(day)))
    assert full == past


def test_many_dates_equal_single_dates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    days = [dt.date(2024, 1, d) for d in (5, 12, 30)]

    def rows(dates):
        out = features.feature_vector(t.customers(), t.purchases(), t.trusted(), t.semantics(), dates, DENSE, prior_days=5)
        return {(r["customer_id"], r["as_of_date"]): tuple(r) for r in out.collect()}

    together = rows(days)
    for d in days:
        for key, row in rows([d]).items():
            assert together[key] == row


def test_snapshot_upsert(spark, tmp_path):
    path = str(tmp_path / "snap")
    schema = "customer_id long, as_of_date date, v long"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    write_snapshot(spark.createDataFrame([(1, d1, 1), (2, d1, 1), (1, d2, 1)], schema), path)
    write_snapshot(spark.createDataFrame([(2, d1, 9), (3, d1, 9)], schema), path)
    got = sorted((r["customer_id"], r["as_of_date"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, d1, 1), (1, d2, 1), (2, d1, 9), (3, d1, 9)]


def test_snapshot_of_repeated_keys_and_unreadable_tables(spark, tmp_path):
    day, schema = dt.date(2024, 1, 1), "customer_id long, as_of_date date, v long"
    path = str(tmp_path / "snap")
    write_snapshot(spark.createDataFrame([(1, day, 5), (1, day, 3)], schema), path)
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [3]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017
        write_snapshot(spark.createDataFrame([(1, day, 1)], schema), str(broken))
    assert (broken / "part-0.parquet").read_bytes() == b"not parquet"


def test_import_of_files_with_other_column_orders_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\nC1,Ann\n")
    (tmp_path / "b.csv").write_text("name,id\nBob,C2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_import_csv(spark, str(tmp_path)).collect()


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(), "x")
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/ck"}
    assert shared_folder(Session(), "x").startswith("hdfs://shared/ck/x-")


def test_correlations_use_all_rows_of_a_pair(spark):
    rows = [(float(i), float(i * i % 17), None if i % 3 else float(-i)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in evaluation.correlations(df, ("a", "b", "c"), above=-1.0).collect()}
    a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert abs(got["a", "b"] - np.corrcoef(a, b)[0, 1]) < 1e-9 and abs(got["a", "c"] + 1) < 1e-9


def test_messages_are_pruned_before_the_joins(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    t = Tables(spark, sf_dir)
    plan = features.feature_vector(t.customers(), t.purchases(), t.trusted(), t.semantics(), [t.anchor("events")], DENSE)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "event_id" in line and "PushedFilters" in line]
    assert any("GreaterThanOrEqual(ts," in line and "LessThan(ts," in line for line in scans)


def test_split_refuses_what_it_cannot_split(spark):
    schema = "observation_date date, customer_id string"
    for rows in ([], [(dt.date(2024, 1, 1), "a")], [(dt.date(2024, 1, 1), "a"), (None, "b"), (dt.date(2024, 1, 2), "c")]):
        with pytest.raises(ValueError):
            training.time_split(spark.createDataFrame(rows, schema))


def test_read_import_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿Message ID, Phone Number ,message_text\nm1,0811,"hello, ""you""\nsecond line"\nm2,,"x"\n', encoding="utf-8")
    got = read_import_csv(spark, str(path), multi_line=True).orderBy("source_row").collect()
    assert [(r["message_id"], r["phone_number"], r["message_text"]) for r in got] == [("m1", "0811", 'hello, "you"\nsecond line'), ("m2", None, "x")]


def test_export_split_inside_a_message(spark, tmp_path):
    """A file cut into several blocks: the header of a long message lies in an earlier block than most of its lines."""
    lines = ["[01/02/24, 10:00] Ann: first"] + [f"line {i}" for i in range(400)] + ["[01/02/24, 10:05] Admin: second", "tail"]
    (tmp_path / "chat.txt").write_text("\n".join(lines), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = read_export_lines(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 3
        got = sorted((r["sender"], r["text"]) for r in parse_chat_export(read).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == [("Admin", "second\ntail"), ("Ann", "\n".join(["first", *lines[1:401]]))]


def test_training_rows_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """Copies of day rows for many dates, and their labels, are not left in the few parts of the day rows."""
    t = Tables(spark, sf_dir)
    dates = training.date_list(training.observation_dates(t.transactions(), training.training_cutoff(t.transactions())))
    made = lambda: training.training_dataset(t.customers(), t.transactions(), t.trusted(), t.semantics(), dates)
    want, first = made(), t.customers().filter("is_active AND NOT is_provisional").count() * len(dates)
    monkeypatch.setattr(features, "PART_ROWS", first // 40)
    parts = made()
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert sum("REPARTITION_BY_NUM" in line for line in plan.split("\n")) >= 4
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 30 and max(sizes) < sum(sizes) / 8
    assert parts.exceptAll(want).count() == want.exceptAll(parts).count() == 0
