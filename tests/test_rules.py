"""Behaviours that are easy to get wrong, on literal rows. Marks such as Q2 name them."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ebbtide.config import BASELINE_FEATURE_NAMES, FEATURE_NAMES, FeatureConfig, feature_schema_hash
from ebbtide.functions import risk, series, text, vectors
from ebbtide.operators import dashboard, explain, features, identity, importing, messages, semantics, training, worklists
from ebbtide.sources.chat_export import parse_chat_export

CUSTOMER = "customer_id long, created_at timestamp_ntz, is_active boolean, is_provisional boolean"
TX = "tx_id long, customer_id long, tx_date timestamp_ntz, service_type string, amount decimal(12,2), status string"


def ts(value):
    return dt.datetime.fromisoformat(value)


def tx_frame(spark, rows, customer=1):
    return spark.createDataFrame([(i, customer, ts(d), "s", Decimal(a), st) for i, (d, a, st) in enumerate(rows)], TX)


def customers(spark, created="2024-01-01T00:00:00"):
    return spark.createDataFrame([(1, ts(created) if created else None, True, False)], CUSTOMER)


def value(spark, column, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column).first()[0] if columns else spark.range(1).select(column).first()[0]


def numeric(spark, rows, as_of="2024-04-10", **config):
    return features.numeric_features(customers(spark), tx_frame(spark, rows), [dt.date.fromisoformat(as_of)], FeatureConfig(**config)).first()


def test_q1_boundary_day_counts_in_both_windows(spark):
    # 30 days before the as-of date is the edge between the two newest windows
    row = numeric(spark, [("2024-03-11T12:00:00", "10", "completed"), ("2024-03-11T00:00:00", "5", "cancelled")])
    assert row["tx_series"] == [0.0, 1.0, 1.0] and row["tx_count_90d"] == 1 and row["spend_series"] == [0.0, 10.0, 10.0]


def test_q1_half_open_windows_do_not_share_days(spark):
    day = dt.date(2024, 4, 10)
    daily = features.daily_transactions(tx_frame(spark, [("2024-03-11T12:00:00", "10", "completed"), ("2024-04-10T01:00:00", "1", "completed")]))
    row = features.windowed_series(daily, [day], FeatureConfig(), {"n": "n"}, "half_open").first()
    assert row["n"] == [0.0, 0.0, 1.0]  # the edge day belongs to the newer window, the as-of day to none


def test_q2_gaps_are_whole_days_and_recency_is_a_date_difference(spark):
    row = numeric(spark, [("2024-04-01T10:00:00", "1", "completed"), ("2024-04-02T09:00:00", "1", "completed"), ("2024-04-04T08:00:00", "1", "completed")])
    assert row["avg_interpurchase_days"] == (0 + 1) / 2  # 23 h and 47 h
    assert row["recency_days"] == 6


def test_q3_no_purchase_gives_999_and_the_cap(spark):
    row = features.derived_features(features.numeric_features(customers(spark), tx_frame(spark, [("2024-04-01T10:00:00", "1", "refunded")]), [dt.date(2024, 4, 10)]), FeatureConfig()).first()
    assert row["recency_days"] == 999 and row["recency_ratio"] == 10.0 and row["avg_tx_value"] == 0.0


def test_tenure_is_zero_when_created_later_or_unknown(spark):
    for created in ("2025-01-01T00:00:00", None):
        row = features.numeric_features(customers(spark, created), tx_frame(spark, [("2024-04-01T10:00:00", "1", "completed")]), [dt.date(2024, 4, 10)]).first()
        assert row["tenure_days"] == 0


def test_q4_q5_head_of_moving_average_and_slope(spark):
    arr = F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0))
    assert value(spark, series.sma(arr, 3)) == [1.0, 1.5, 3.0]
    assert value(spark, series.trend_slope(series.sma(arr, 3))) == pytest.approx(1.0)
    assert value(spark, series.smooth(F.array(F.lit(5.0)), FeatureConfig())) == [5.0]
    assert value(spark, series.ema(arr, 0.5)) == [1.0, 1.5, 3.75]
    assert value(spark, series.trend_slope(F.array(F.lit(7.0)))) == 0.0


def test_array_and_column_forms_agree(spark):
    cols = [F.lit(x) for x in (3.0, 0.0, 8.0, 4.0)]
    arr = F.array(*cols)
    for config in (FeatureConfig(), FeatureConfig(smoothing_method="ema"), FeatureConfig(smoothing_window=2)):
        assert value(spark, F.array(*series.smooth_of(cols, config))) == pytest.approx(value(spark, series.smooth(arr, config)))
        assert value(spark, series.slope_of(cols)) == pytest.approx(value(spark, series.trend_slope(arr)))
        std = series.std_of(cols, series.mean_of(cols))
        assert value(spark, std) == pytest.approx(value(spark, series.std_pop(arr)))
        assert value(spark, series.capped_cv_of(std, series.mean_of(cols), config)) == pytest.approx(value(spark, series.capped_cv(arr, config)))


def test_dormant_series_are_not_volatile(spark):
    assert value(spark, series.capped_cv(F.array(F.lit(0.0), F.lit(0.0)), FeatureConfig())) == 0.0


def _trusted(spark, rows):
    return spark.createDataFrame([(1, i, ts(t), c, n, r) for i, (t, c, n, r) in enumerate(rows)],
                                 "customer_id long, msg_id long, timestamp timestamp_ntz, has_complaint boolean, msg_length int, response_time_secs int")


def test_q6_three_volatilities(spark):
    daily = features.daily_messages(_trusted(spark, [("2024-04-09T10:00:00", False, 1, None), ("2024-04-09T11:00:00", False, 1, None), ("2024-04-10T11:00:00", True, 1, None)]))
    got = {m: features.msg_volatility(daily, [dt.date(2024, 4, 10)], m).first()["msg_volatility"] for m in ("calendar", "active", "training")}

    def std(xs):
        mean = sum(xs) / len(xs)
        return (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5

    assert got["calendar"] == pytest.approx(std([2, 1] + [0] * 29))
    assert got["active"] == pytest.approx(std([2, 1]))
    assert got["training"] == pytest.approx(std([2] + [0] * 29))


def test_q7_zero_delays_and_lengths_do_not_count(spark):
    trusted = _trusted(spark, [("2024-04-09T10:00:00", False, 0, 0), ("2024-04-09T11:00:00", False, 8, 30), ("2024-04-10T11:00:00", True, 4, None)])
    day = [dt.date(2024, 4, 10)]
    row = features.text_signals(customers(spark), trusted, day).first()
    assert (row["avg_msg_length_30d"], row["response_delay_mean"], row["msg_count_7d"]) == (6.0, 30.0, 3)
    assert features.text_signals(customers(spark), trusted, day, delay_ignores_zero=False).first()["response_delay_mean"] == 15.0


def test_no_messages_give_zeros(spark):
    row = features.text_signals(customers(spark), _trusted(spark, [("2023-01-09T10:00:00", False, 0, 0)]), [dt.date(2024, 4, 10)]).first()
    assert [row[c] for c in ("msg_count_7d", "msg_count_30d", "complaint_rate_30d", "avg_msg_length_30d", "response_delay_mean", "msg_volatility")] == [0, 0, 0.0, 0.0, 0.0, 0.0]


def test_q8_missing_prior_score_counts_as_zero(spark):
    sem = spark.createDataFrame([(1, dt.date(2024, 4, 10), 0.5), (1, dt.date(2024, 3, 1), None), (1, dt.date(2024, 2, 1), 0.9)], "customer_id long, as_of_date date, avg_sentiment_score double")
    spine = features.customer_spine(customers(spark), [dt.date(2024, 4, 10)])
    row = features.sentiment_features(spine, sem, [dt.date(2024, 4, 10)]).first()
    assert (row["avg_sentiment_score"], row["sentiment_trend"]) == (0.5, 0.5)
    other = dt.date(2024, 4, 11)  # no snapshot exactly here
    row = features.sentiment_features(features.customer_spine(customers(spark), [other]), sem, [other]).first()
    assert (row["avg_sentiment_score"], row["sentiment_trend"]) == (0.0, 0.0)


def test_q9_first_unknown_message_creates_later_ones_match(spark):
    msgs = spark.createDataFrame([(3, "h1", ts("2024-01-02T00:00:00")), (1, "h1", ts("2024-01-01T00:00:00")), (2, "h2", ts("2024-01-01T00:00:00")), (4, "h3", ts("2024-01-01T00:00:00")), (5, "", ts("2024-01-01T00:00:00"))],
                                 "msg_id long, phone_number string, timestamp timestamp_ntz")
    people = spark.createDataFrame([("c2", "h2", False), ("c3", "h3", True)], "customer_id string, phone_hash string, is_provisional boolean")
    none = spark.createDataFrame([], "msg_id long")
    links = {r["msg_id"]: r for r in identity.link_messages(msgs, people, none).collect()}
    assert (links[1]["match_confidence"], links[1]["match_method"]) == (0.5, "auto_created_provisional")
    assert (links[3]["match_confidence"], links[3]["match_method"], links[3]["customer_id"]) == (0.6, "phone_provisional", links[1]["customer_id"])
    assert (links[2]["match_confidence"], links[2]["match_method"], links[2]["link_status"]) == (1.0, "phone_exact", "probable")
    assert (links[4]["match_confidence"], links[4]["link_status"]) == (0.6, "provisional")
    assert 5 not in links


def test_q10_one_normaliser_with_salt(spark):
    df = spark.createDataFrame([("0812-345",), ("+62 812345",), ("",), (None,)], "p string")
    plain = [r[0] for r in df.select(text.hash_phone(F.col("p"))).collect()]
    assert plain[0] == plain[1] and plain[2] is None and plain[3] is None
    assert df.select(text.hash_phone(F.col("p"), "x")).first()[0] != plain[0]


def test_q11_unusable_first_row_still_blocks_its_id(spark):
    df = spark.createDataFrame([(2, "T1", "C9", "2024-01-01", "5", "s", "completed"), (3, "T1", "C1", "2024-01-01", "5", "s", "weird"), (4, "T2", "C1", "2024-01-01", "-5", None, "weird")],
                               "row long, transaction_id string, customer_id string, transaction_date string, transaction_amount string, service_type string, transaction_status string")
    people = spark.createDataFrame([("C1", 1)], "external_id string, customer_id long")
    got = {r["row"]: r for r in importing.import_transactions(df, people).collect()}
    assert (got[2]["outcome"], got[3]["outcome"], got[4]["outcome"]) == ("skipped_unknown_customer", "duplicate", "imported")
    assert (got[4]["status"], got[4]["amount"], got[4]["service_type"]) == ("completed", Decimal("-5.00"), "unknown")  # Q13


def test_q12_missing_cells_are_not_the_word_nan(spark):
    df = spark.createDataFrame([(2, None, "x", None, "2024-01-01")], "row long, customer_id string, customer_name string, phone_number string, join_date string")
    assert [r["message"] for r in importing.validate_customers(df).collect()] == ["customer_id is empty"]


def test_q15_thresholds(spark):
    df = spark.createDataFrame([(0.39,), (0.40,), (0.899,), (0.90,)], "s double")
    assert [r[0] for r in df.select(risk.risk_label(F.col("s"))).collect()] == ["low", "medium", "medium", "high"]


def test_risk_floor(spark):
    rows = [(0.1, 200, 0, 0.0), (0.1, 130, 0, 0.0), (0.1, 90, 0, 0.0), (0.1, 89, 0, 0.0), (0.95, 200, 0, 0.0), (0.1, 200, 1, 0.0)]
    df = spark.createDataFrame(rows, "s double, r int, n int, m double")
    assert [r[0] for r in df.select(risk.risk_floor(F.col("s"), F.col("r"), F.col("n"), F.col("m"))).collect()] == [0.9, 0.8, 0.65, 0.1, 0.95, 0.1]


def test_q16_rows_of_one_moment_all_stay(spark):
    df = spark.createDataFrame([(1, 1, ts("2024-01-02T00:00:00")), (2, 1, ts("2024-01-02T00:00:00")), (3, 1, ts("2024-01-01T00:00:00"))], "pred_id long, customer_id long, created_at timestamp_ntz")
    assert sorted(r["pred_id"] for r in dashboard.latest_predictions(df).collect()) == [1, 2]


def _lines(spark, content, per_block=None):
    rows = [("f", 0 if per_block is None else i // per_block, i, x) for i, x in enumerate(content.split("\n"))]
    return spark.createDataFrame(rows, "file string, block long, line_no long, line string")


CHAT = """orphan line
[01/02/24, 10:00] Ana: hello

  second line
[99/99/24, 10:00] Bob: lost header
kept by Ana
[01/02/24, 10:01:30] Spa Admin: <Media omitted>
[01/02/2024, 10:02:30] My ADMIN desk: hi: there
[03/02/99, 9:05] Cleo: old"""


@pytest.mark.parametrize("per_block", [None, 1, 2, 3])
def test_q25_chat_export(spark, per_block):
    got = parse_chat_export(_lines(spark, CHAT, per_block), "admin").orderBy("message_block", "message_line").collect()
    assert [(r["sender"], r["text"], r["direction"]) for r in got] == [
        ("Ana", "hello\nsecond line\nkept by Ana", "inbound"), ("My ADMIN desk", "hi: there", "outbound"), ("Cleo", "old", "inbound")]
    assert [r["timestamp"] for r in got] == [ts("2024-02-01T10:00:00"), ts("2024-02-01T10:02:30"), ts("1999-02-03T09:05:00")]


def test_q28_dropped_rows_do_not_block(spark):
    rows = [(2, "a", "0811"), (3, "b", "0811"), (4, "b", "0822"), (5, "c", "0822"), (6, "c", "0833"), (7, "", "0844"), (8, "d", None)]
    df = spark.createDataFrame([(r, i, "n", p, "2024-01-01") for r, i, p in rows], "row long, customer_id string, customer_name string, phone_number string, join_date string")
    none = spark.createDataFrame([], "external_id string, phone_hash string")
    got = {r["row"]: r["outcome"] for r in importing.import_customers(df, none).collect()}
    assert got == {2: "imported", 3: "duplicate", 4: "imported", 5: "duplicate", 6: "imported", 7: "skipped_empty_id", 8: "imported"}


def test_greedy_import_equals_reading_top_down(spark):
    import random

    rng = random.Random(3)
    rows = [(i, f"i{rng.randrange(40)}", f"08{rng.randrange(40)}") for i in range(120)]
    df = spark.createDataFrame([(r, i, "n", p, "2024-01-01") for r, i, p in rows], "row long, customer_id string, customer_name string, phone_number string, join_date string")
    none = spark.createDataFrame([], "external_id string, phone_hash string")
    ids, phones, want = set(), set(), set()
    for r, i, p in rows:
        if i not in ids and p not in phones:
            ids.add(i), phones.add(p), want.add(r)
    assert {r["row"] for r in importing.import_customers(df, none).filter("outcome = 'imported'").collect()} == want


def test_dates(spark):
    df = spark.createDataFrame([("2024-03-09 10:15:00",), ("09/03/2024",), ("9-3-2024",), ("2024/03/09",), ("03/25/2024",), ("rubbish",), ("",), (None,)], "d string")
    got = [r[0] for r in df.select(text.parse_datetime(F.col("d"))).collect()]
    day = ts("2024-03-09T00:00:00")
    assert got == [ts("2024-03-09T10:15:00"), day, day, day, ts("2024-03-25T00:00:00"), None, None, None]


COMPLAINTS = [("Saya sangat kecewa dengan layanan ini", True, False), ("Treatment telat dan lama banget", True, False), ("Produknya tidak  sesuai", True, False),
              ("Terima kasih, pelayanan bagus", False, False), ("Tolong refund uang saya", True, True), ("Saya mau cancel booking", True, True),
              ("Bisa uang kembali?", True, True), ("Mau booking untuk besok", False, False), ("kembalikan uang!", True, True), ("rusaknya", False, False), (None, False, False)]


def test_last_resort_dates_keep_the_wall_time(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-05-06T07:08:09", "2024-05-06 07:08:09.250000", "6 May 2024", "May 6, 2024", "2024-05-06T07:08:09Z", "2024-03-10 02:30:00", "31/04/2024", "6 Maybe 2024", "2024-05-06 25:00"]
    want = [ts("2024-05-06T07:08:09"), ts("2024-05-06T07:08:09.250000"), ts("2024-05-06T00:00:00"), ts("2024-05-06T00:00:00"), ts("2024-05-06T07:08:09"), ts("2024-03-10T02:30:00"), None, None, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, d string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r[0] for r in df.orderBy("i").select(text.parse_datetime(F.col("d"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_every_rule_finds_its_wording(spark):
    complaints = ("komplain keluhan kecewa buruk parah rusak cacat jelek telat terlambat lambat kasar".split()
                  + [f"{no} {word}" for no in ("tidak", "nggak", "gak") for word in ("puas", "sesuai", "bagus", "baik")]
                  + [f"kurang  {word}" for word in ("puas", "bagus", "baik", "bersih", "ramah")] + ["lama banget"])
    refunds = ["refund", "uang kembali", "kembali uang", "kembalikan uang", "balikin uang", "dana kembali", "cancel booking", "batal booking", "batalkan booking"]
    rows = [(x, x in refunds) for x in complaints + refunds]
    df = spark.createDataFrame([(f"ya, {x}.", r) for x, r in rows], "t string, r boolean")
    assert df.filter(~text.detect_complaint(F.col("t")) | (text.detect_refund(F.col("t")) != F.col("r"))).count() == 0
    assert len(text.COMPLAINT_PATTERNS) == 17 and len(text.REFUND_PATTERNS) == 7


def test_complaint_and_refund_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(COMPLAINTS)], "i int, t string")
    got = df.select(text.detect_complaint(F.col("t")), text.detect_refund(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(c, r) for _, c, r in COMPLAINTS]


def test_message_counts(spark):
    stats = text.message_stats(F.lit("Pesanan sampai! Bisa kirim nota?! Makasih ya!"))
    assert value(spark, F.struct(stats["num_exclamations"], stats["num_questions"])) == (3, 1)


def test_masks(spark):
    assert value(spark, text.mask_phone(F.lit("08123456789"))) == "0812****6789"
    assert value(spark, text.mask_phone(F.lit("0812345"))) == "0812345"
    assert value(spark, text.truncate(F.lit("x" * 30), 20)) == "x" * 20 + "..."


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("[5E-1]",), ("2.5",), ("None",), ("nan",), (None,), ("abc",)], "v string")
    assert [r[0] for r in df.select(text.coerce_numeric(F.col("v"))).collect()] == [0.5, 2.5, 0.0, 0.0, 0.0, 0.0]


def test_mean_embedding(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 1), (1, [1.5, 1.5], 2), (1, [0.0, 0.0], 3), (1, None, 4), (2, None, 5)], "customer_id long, embedding array<float>, at long")
    got = {r["customer_id"]: r for r in messages.mean_embedding(df, order="at").collect()}
    assert got[1]["avg_embedding"] == [1.0, 1.0] and got[1]["embedding_count"] == 2 and got[1]["last_embedding"] == [1.5, 1.5]
    assert got[2]["avg_embedding"] is None and got[2]["embedding_count"] == 0


def test_cosine_errors_have_reasons(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine_reason(F.col("a"), F.col("b"))).collect()]
    assert got == [(1.0, None), (None, "zero_vector"), (None, "missing_vector")]


def test_response_times_cross_blocks(spark):
    rows = [(1, 1, "inbound", "2024-01-01T10:00:00"), (2, 1, "inbound", "2024-01-01T10:30:00"), (3, 1, "outbound", "2024-01-03T10:30:00"), (4, 1, "inbound", "2024-01-03T11:00:00"), (5, 2, "outbound", "2024-01-03T11:30:00")]
    df = spark.createDataFrame([(m, c, d, ts(t)) for m, c, d, t in rows], "msg_id long, customer_id long, direction string, timestamp timestamp_ntz")
    got = {r["msg_id"]: r["response_time_secs"] for r in messages.response_times(df).collect()}
    assert got == {1: 2 * 86400 + 1800, 2: 2 * 86400, 4: None}


def test_embeddings_of_blank_texts_are_missing(spark):
    df = spark.createDataFrame([(1, "halo dunia"), (2, "  "), (3, None)], "msg_id long, text string")
    got = {r["msg_id"]: r["embedding"] for r in messages.embed_messages(df).collect()}
    assert len(got[1]) == 64 and got[2] is None and got[3] is None


def test_sentiment_and_semantics_edge_rows(spark):
    df = spark.createDataFrame([(1, "bagus, tapi telat dan kotor"), (2, ""), (3, None)], "customer_id long, text string")
    got = {r["customer_id"]: (r["sentiment_label"], r["sentiment_score"]) for r in semantics.score_sentiment(df).collect()}
    assert got == {1: ("negative", round(-1 / 3, 4)), 2: ("neutral", 0.0), 3: ("neutral", 0.0)}
    m = F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(2), F.lit("c"), F.lit(1))
    assert value(spark, semantics.dominant(m)) == "a"


def test_topic_names(spark):
    df = spark.createDataFrame([(0, ["booking", "jam", "bayi"]), (1, ["foo", "bar", "baz", "x"]), (2, [])], "topic_idx int, top_keywords array<string>")
    assert [r["name"] for r in semantics.name_topics(df).orderBy("topic_idx").collect()] == ["Reservasi & Jadwal", "Foo / Bar / Baz", "Topic 2"]


def test_topic_counts_use_the_latest_version(spark):
    topics = spark.createDataFrame([(1, 0, "old", "v1", ts("2024-01-01T00:00:00")), (2, 0, "new", "v2", ts("2024-02-01T00:00:00"))], "topic_id long, topic_idx long, name string, model_version string, created_at timestamp_ntz")
    sem = spark.createDataFrame([(1, {"0": 5}, "v1"), (1, {"0": 2}, "v2")], "customer_id long, top_topic_counts map<string,bigint>, topic_model_version string")
    assert [(r["name"], r["message_count"]) for r in semantics.topic_message_counts(topics, sem).collect()] == [("new", 2)]
    assert [(r["name"], r["message_count"]) for r in semantics.topic_message_counts(topics, sem, "v1").collect()] == [("old", 5)]


def test_observation_dates_short_history(spark):
    tx = tx_frame(spark, [("2024-01-10T00:00:00", "1", "completed"), ("2024-06-10T00:00:00", "1", "completed")])
    assert training.date_list(training.observation_dates(tx, dt.date(2024, 3, 1))) == [dt.date(2024, 3, 1)]
    assert training.date_list(training.observation_dates(tx, dt.date(2024, 5, 20))) == [dt.date(2024, 5, 1), dt.date(2024, 5, 20)]
    assert training.date_list(training.observation_dates(tx, dt.date(2024, 5, 1))) == [dt.date(2024, 5, 1)]


def test_label_window_is_half_open(spark):
    obs = dt.date(2024, 2, 1)
    for last, churned in (("2024-02-01T00:00:00", 0), ("2024-04-30T23:00:00", 0), ("2024-05-01T00:00:00", 1)):
        tx = tx_frame(spark, [("2024-01-10T00:00:00", "1", "completed"), (last, "1", "completed")])
        row = training.churn_labels(tx, [obs]).first()
        assert (row["churned"], row["last_tx_before"]) == (churned, dt.date(2024, 1, 10))


def test_reasons_skip_neutral_and_derived_ratio(spark):
    contrib = [("tenure_days", 5.0, 9.0), ("recency_ratio", 10.0, 8.0), ("recency_days", 120.0, 1.0), ("tx_count_90d", 0.0, -2.0)]
    df = spark.createDataFrame([(1, contrib)], "customer_id long, contributions array<struct<feature:string,value:double,contribution:double>>")
    got = explain.describe_reasons(explain.top_reasons(df).select("customer_id", "reasons")).orderBy("rank").collect()
    assert [(r["feature"], r["description"]) for r in got] == [
        ("tx_count_90d", "Jumlah transaksi 90 hari terakhir (menurunkan risiko)"), ("recency_days", "Sudah lama tidak bertransaksi (meningkatkan risiko)")]


def test_urgency_and_advice(spark):
    rows = [("high", 10, "pending"), ("high", None, None), ("high", 60, "completed"), ("high", 59, None), ("medium", 5, None), ("low", 5, None)]
    df = spark.createDataFrame(rows, "l string, r int, a string")
    assert [r[0] for r in df.select(risk.urgency(F.col("l"), F.col("r"), F.col("a"))).collect()] == ["in_progress", "critical", "critical", "high", "medium", "low"]
    assert value(spark, worklists.recommendation(F.lit("none"), F.lit("high")))["action_type"] == "call"
    assert value(spark, worklists.recommendation(F.lit("none"), F.lit("low")))["action_type"] == "email"


def test_due_states(spark):
    df = spark.createDataFrame([(None,), (dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),), (dt.date(2024, 1, 4),), (dt.date(2024, 1, 5),)], "d date")
    assert [r[0] for r in df.select(risk.due_state(F.col("d"), F.lit(dt.date(2024, 1, 2)))).collect()] == ["none", "overdue", "today", "soon", "later"]


def test_config_and_schema():
    assert len(FEATURE_NAMES) == 20 and len(BASELINE_FEATURE_NAMES) == 14 and len(feature_schema_hash()) == 16
    assert FeatureConfig.from_dict({"smoothing_window": 5, "unknown": 1}).smoothing_window == 5
    assert FeatureConfig().alpha == 0.5
    for bad in ({"smoothing_method": "x"}, {"smoothing_window": 0}, {"activity_windows": 1}, {"ema_alpha": 0.0}, {"window_size_days": 0}, {"min_activity_threshold": -1}):
        with pytest.raises(ValueError):
            FeatureConfig(**bad)


ADVICE = [
    ("recency_days", "low", "call", "Hubungi personal", "sapaan personal"), ("recency_ratio", "high", "call", "Hubungi personal", "jadwal yang tersedia"),
    ("tx_count_90d", "low", "call", "Kirim reminder", "paket rutin"), ("activity_mean", "low", "call", "Kirim reminder", "Aktivitas kunjungan menurun"),
    ("spend_90d", "low", "promo", "Tawarkan promo", "histori layanan"), ("sentiment_trend", "low", "call", "Follow-up keluhan", "klarifikasi"),
    ("response_delay_mean", "low", "call", "Respon cepat", "respons personal"), ("tenure_days", "high", "call", "hari ini", "risiko tinggi"),
    ("tenure_days", "medium", "email", "Pantau", "check-in ringan"), ("", "low", "email", "Pantau", "belum masuk prioritas"),
]


def test_advice_for_every_leading_feature(spark):
    df = spark.createDataFrame([(i, f, label) for i, (f, label, *_) in enumerate(ADVICE)], "i int, f string, l string")
    got = [r[0] for r in df.orderBy("i").select(worklists.recommendation(F.col("f"), F.col("l"))).collect()]
    for r, (_, _, kind, text_part, note_part) in zip(got, ADVICE):
        assert r["action_type"] == kind and text_part in r["label"] and note_part in r["notes"]


def _reader(rows):
    """Rows kept by reading top to bottom."""
    ids, phones, kept = set(), set(), []
    for r, i, h in sorted(rows):
        if i not in ids and (h is None or h not in phones):
            ids.add(i)
            if h is not None:
                phones.add(h)
            kept.append(r)
    return kept


def test_chains_of_conflicts_take_few_passes(spark, monkeypatch):
    from ebbtide.operators import importing

    schema = "row long, _id string, _hash string"
    chain = [(k, f"i{(k + 1) // 2}", f"h{k // 2}") for k in range(300)]  # each row conflicts with the one before and the one after
    passes = []
    plain = importing._chained
    monkeypatch.setattr(importing, "_chained", lambda u, row: passes.append(1) or plain(u, row))
    got = importing._greedy_first(spark.createDataFrame(chain, schema), "row")
    assert sorted(r["row"] for r in got.collect()) == _reader(chain) and len(passes) <= 2
    rng = random.Random(4)
    for n, ids, phones in ((200, 60, 60), (150, 8, 100), (120, 40, 5)):
        rows = [(k, f"i{rng.randrange(ids)}", rng.choice([None, f"h{rng.randrange(phones)}"])) for k in range(n)]
        got = importing._greedy_first(spark.createDataFrame(rows, schema), "row")
        assert sorted(r["row"] for r in got.collect()) == _reader(rows)
