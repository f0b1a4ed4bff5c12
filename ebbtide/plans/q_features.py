"""Queries over the customer feature operators (D, B13, B14, F1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ebbtide.config import FEATURE_NAMES, FeatureConfig, feature_schema_hash
from ebbtide.functions import series as S
from ebbtide.functions.risk import risk_floor, risk_label
from ebbtide.functions.text import coerce_numeric
from ebbtide.operators import features as D
from ebbtide.operators import stored as ST
from ebbtide.plans.bindings import DENSE, YEARLY, Tables, add_cte, r6
from ebbtide.plans.registry import query
from ebbtide.sources.imports import scratch_dir


# ---------------------------------------------------------------------------------------------
# The feature definitions once more, as SQL over a (customer_id, as_of_date) spine
# ---------------------------------------------------------------------------------------------
def feature_ctes(s: str, needs: str, spine_sql: str, tx: str, width: int, wide: int, text_days: int = 30, active_std: bool = False, prior: int = 30) -> None:
    add_cte(f"spine_{s}", needs, spine_sql)
    add_cte(f"num_{s}", f"spine_{s} {tx}", f"""
        SELECT s.customer_id, s.as_of_date,
               coalesce(date_diff('day', CAST(max(t.tx_date) AS DATE), s.as_of_date), 999) AS recency_days,
               count(CASE WHEN CAST(t.tx_date AS DATE) >= s.as_of_date - 30 THEN 1 END) AS tx_count_30d,
               count(CASE WHEN CAST(t.tx_date AS DATE) >= s.as_of_date - {wide} THEN 1 END) AS tx_count_90d,
               CAST(coalesce(sum(CASE WHEN CAST(t.tx_date AS DATE) >= s.as_of_date - 30 THEN t.amount END), 0) AS DOUBLE) AS spend_30d,
               CAST(coalesce(sum(CASE WHEN CAST(t.tx_date AS DATE) >= s.as_of_date - {wide} THEN t.amount END), 0) AS DOUBLE) AS spend_90d,
               CASE WHEN tx_count_90d > 0 THEN spend_90d / tx_count_90d ELSE 0.0 END AS avg_tx_value,
               greatest(0, coalesce(date_diff('day', CAST(any_value(s.created_at) AS DATE), s.as_of_date), 0)) AS tenure_days
        FROM spine_{s} s LEFT JOIN {tx} t ON t.customer_id = s.customer_id AND t.status = 'completed' AND CAST(t.tx_date AS DATE) <= s.as_of_date
        GROUP BY s.customer_id, s.as_of_date""")
    add_cte(f"gap_{s}", f"spine_{s} {tx}", f"""
        SELECT customer_id, as_of_date, avg(date_sub('day', prev, tx_date)) AS avg_gap FROM (
            SELECT s.customer_id, s.as_of_date, t.tx_date, lag(t.tx_date) OVER (PARTITION BY s.customer_id, s.as_of_date ORDER BY t.tx_date) AS prev
            FROM spine_{s} s JOIN {tx} t ON t.customer_id = s.customer_id AND t.status = 'completed' AND CAST(t.tx_date AS DATE) <= s.as_of_date)
        WHERE prev IS NOT NULL GROUP BY 1, 2""")
    add_cte(f"wins_{s}", f"spine_{s}", f"""
        SELECT customer_id, as_of_date, i AS idx, as_of_date - CAST((2 - i) * {width} + {width} AS INTEGER) AS d0, as_of_date - CAST((2 - i) * {width} AS INTEGER) AS d1
        FROM spine_{s}, (SELECT unnest([0, 1, 2]) AS i)""")
    add_cte(f"ser_{s}", f"wins_{s} trusted {tx}", f"""
        SELECT w.customer_id, w.as_of_date, w.idx, CAST(coalesce(t.n, 0) AS DOUBLE) AS n, coalesce(t.spend, 0.0) AS spend, CAST(coalesce(m.n, 0) AS DOUBLE) AS msgs
        FROM wins_{s} w
        LEFT JOIN (SELECT w.customer_id, w.as_of_date, w.idx, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS spend
                   FROM wins_{s} w JOIN {tx} t ON t.customer_id = w.customer_id AND t.status = 'completed' AND CAST(t.tx_date AS DATE) BETWEEN w.d0 AND w.d1 GROUP BY 1, 2, 3) t
          ON t.customer_id = w.customer_id AND t.as_of_date = w.as_of_date AND t.idx = w.idx
        LEFT JOIN (SELECT w.customer_id, w.as_of_date, w.idx, count(*) AS n
                   FROM wins_{s} w JOIN trusted t ON t.customer_id = w.customer_id AND t.day BETWEEN w.d0 AND w.d1 GROUP BY 1, 2, 3) m
          ON m.customer_id = w.customer_id AND m.as_of_date = w.as_of_date AND m.idx = w.idx""")
    add_cte(f"sm_{s}", f"ser_{s}", f"""
        SELECT *, avg(n) OVER w AS n_s, avg(spend) OVER w AS spend_s, avg(msgs) OVER w AS msgs_s FROM ser_{s}
        WINDOW w AS (PARTITION BY customer_id, as_of_date ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
    add_cte(f"trend_{s}", f"sm_{s}", f"""
        SELECT customer_id, as_of_date, regr_slope(n_s, idx) AS f_slope, regr_slope(spend_s, idx) AS s_slope, regr_slope(msgs_s, idx) AS m_slope,
               avg(n) AS n_mean, max(CASE WHEN idx = 2 THEN n END) AS n_last, stddev_pop(n) AS n_std, avg(spend) AS s_mean, stddev_pop(spend) AS s_std
        FROM sm_{s} GROUP BY 1, 2""")
    fill = f"generate_series(0, {text_days})"
    std = (
        f"""SELECT customer_id, as_of_date, stddev_pop(c) AS vol FROM (
            SELECT s.customer_id, s.as_of_date, t.day, count(*) AS c FROM spine_{s} s JOIN trusted t ON t.customer_id = s.customer_id
            AND t.day BETWEEN s.as_of_date - {text_days} AND s.as_of_date GROUP BY 1, 2, 3) GROUP BY 1, 2"""
        if active_std else
        f"""SELECT s.customer_id, s.as_of_date, stddev_pop(coalesce(c.n, 0)) AS vol
            FROM (SELECT customer_id, as_of_date, as_of_date - CAST(g AS INTEGER) AS day FROM spine_{s}, (SELECT unnest({fill}) AS g)) s
            LEFT JOIN (SELECT customer_id, day, count(*) AS n FROM trusted GROUP BY 1, 2) c ON c.customer_id = s.customer_id AND c.day = s.day GROUP BY 1, 2"""
    )
    add_cte(f"vol_{s}", f"spine_{s} trusted", std)
    add_cte(f"txt_{s}", f"spine_{s} trusted vol_{s}", f"""
        SELECT s.customer_id, s.as_of_date, count(CASE WHEN t.day >= s.as_of_date - 7 THEN 1 END) AS msg_count_7d, count(t.msg_id) AS msg_count_30d,
               coalesce(avg(CASE WHEN t.has_complaint THEN 1.0 WHEN t.msg_id IS NOT NULL THEN 0.0 END), 0) AS complaint_rate_30d,
               coalesce(avg(nullif(t.msg_length, 0)), 0) AS avg_msg_length_30d, coalesce(avg(nullif(t.response_time_secs, 0)), 0) AS response_delay_mean,
               coalesce(any_value(v.vol), 0) AS msg_volatility
        FROM spine_{s} s LEFT JOIN trusted t ON t.customer_id = s.customer_id AND t.day BETWEEN s.as_of_date - {text_days} AND s.as_of_date
        LEFT JOIN vol_{s} v ON v.customer_id = s.customer_id AND v.as_of_date = s.as_of_date GROUP BY 1, 2""")
    add_cte(f"sent_{s}", f"spine_{s} semantics", f"""
        SELECT s.customer_id, s.as_of_date, coalesce(c.avg_sentiment_score, 0.0) AS avg_sentiment_score,
               CASE WHEN c.avg_sentiment_score IS NULL THEN 0.0 ELSE c.avg_sentiment_score - coalesce(p.avg_sentiment_score, 0.0) END AS sentiment_trend
        FROM spine_{s} s LEFT JOIN semantics c ON c.customer_id = s.customer_id AND c.as_of_date = s.as_of_date
        LEFT JOIN (SELECT s.customer_id, s.as_of_date, m.avg_sentiment_score FROM spine_{s} s JOIN semantics m
                   ON m.customer_id = s.customer_id AND m.as_of_date <= s.as_of_date - {prior}
                   QUALIFY row_number() OVER (PARTITION BY s.customer_id, s.as_of_date ORDER BY m.as_of_date DESC) = 1) p
          ON p.customer_id = s.customer_id AND p.as_of_date = s.as_of_date""")
    add_cte(f"vec_{s}", f"num_{s} gap_{s} trend_{s} txt_{s} sent_{s}", f"""
        SELECT n.customer_id, n.as_of_date,
               CAST(CASE WHEN coalesce(avg_gap, 0) = 0 THEN CASE WHEN recency_days = 0 THEN 1.0 ELSE 10.0 END ELSE least(10.0, recency_days / avg_gap) END AS DOUBLE) AS recency_ratio,
               f_slope AS frequency_trend_smoothed, s_slope AS spend_trend_smoothed, m_slope AS msg_trend_smoothed, CAST(sentiment_trend AS DOUBLE) AS sentiment_trend,
               CAST(recency_days AS DOUBLE) AS recency_days, CAST(tx_count_90d AS DOUBLE) AS tx_count_90d, spend_90d, avg_tx_value, CAST(tenure_days AS DOUBLE) AS tenure_days,
               n_mean AS activity_mean, n_last AS recent_activity_avg, n_std AS activity_std,
               CASE WHEN n_mean >= 0.01 THEN least(10.0, n_std / n_mean) ELSE 0.0 END AS activity_cv,
               CASE WHEN s_mean >= 0.01 THEN least(10.0, s_std / s_mean) ELSE 0.0 END AS spend_volatility_cv,
               f_slope * n_mean AS trend_magnitude_interaction, CAST(avg_sentiment_score AS DOUBLE) AS avg_sentiment_score,
               CAST(complaint_rate_30d AS DOUBLE) AS complaint_ratio, CAST(msg_volatility AS DOUBLE) AS msg_volatility,
               CAST(response_delay_mean AS DOUBLE) AS response_delay_mean, msg_count_30d AS trusted_feedback_used
        FROM num_{s} n JOIN trend_{s} USING (customer_id, as_of_date) JOIN txt_{s} USING (customer_id, as_of_date)
        JOIN sent_{s} USING (customer_id, as_of_date) LEFT JOIN gap_{s} USING (customer_id, as_of_date)""")


_SPINE = "SELECT c.customer_id, c.created_at, c.is_active, a.as_of AS as_of_date FROM customers c, {} a"
feature_ctes("e", "customers anchor_events", _SPINE.format("anchor_events"), "purchases", 10, 90, prior=10)
feature_ctes("ev", "customers anchor_events", _SPINE.format("anchor_events"), "purchases", 10, 30, text_days=10, active_std=True, prior=10)
feature_ctes("o", "customers anchor_orders", _SPINE.format("anchor_orders"), "transactions", 365, 90)
feature_ctes("o30", "customers anchor_orders", _SPINE.format("anchor_orders"), "transactions", 30, 90)

VECTOR_SQL = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in FEATURE_NAMES)


def rounded(df, extra: tuple[str, ...] = ()):
    return df.select("customer_id", "as_of_date", *[r6(n).alias(n) for n in FEATURE_NAMES], *extra)


def dense_vector(t: Tables, dates: list[dt.date] | None = None, mode: str = "persisted"):
    dates = dates or [t.anchor("events")]
    return D.feature_vector(t.customers(), t.purchases(), t.trusted(), t.semantics(), dates, DENSE, mode, prior_days=10)


# ---------------------------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------------------------
@query("default_as_of_date", "SELECT max(d) AS as_of_date FROM (SELECT max(CAST(tx_date AS DATE)) AS d FROM purchases UNION ALL SELECT max(CAST(timestamp AS DATE)) FROM messages)", "purchases messages")
def _(t):
    return D.default_as_of_date(t.purchases(), t.messages())


@query("training_cutoff", "SELECT as_of - 90 AS cutoff_date FROM anchor_orders", "anchor_orders")
def _(t):
    return D.default_as_of_date(t.transactions()).select(F.date_sub("as_of_date", 90).alias("cutoff_date"))


_NUM_COLS = "customer_id, as_of_date, recency_days, tx_count_30d, tx_count_90d, round(spend_30d, 6) AS spend_30d, round(spend_90d, 6) AS spend_90d, round(avg_tx_value, 6) AS avg_tx_value, tenure_days"


def _num_select(df):
    return df.select("customer_id", "as_of_date", "recency_days", "tx_count_30d", "tx_count_90d", r6("spend_30d").alias("spend_30d"), r6("spend_90d").alias("spend_90d"), r6("avg_tx_value").alias("avg_tx_value"), "tenure_days")


@query("numeric_features", f"SELECT {_NUM_COLS} FROM num_o", "num_o")
def _(t):
    return _num_select(D.numeric_features(t.customers(), t.transactions(), [t.anchor("orders")], YEARLY))


@query("numeric_features_dense", f"SELECT {_NUM_COLS} FROM num_e", "num_e")
def _(t):
    return _num_select(D.numeric_features(t.customers(), t.purchases(), [t.anchor("events")], DENSE))


@query("rfm_scores", """
    SELECT customer_id, as_of_date, round(greatest(0.0, 5.0 - recency_days / 36.0::DOUBLE), 2) AS r_score,
           round(least(5.0, tx_count_90d / 2.0::DOUBLE), 2) AS f_score, round(least(5.0, spend_90d / 1000000.0::DOUBLE), 2) AS m_score FROM num_o""", "num_o")
def _(t):
    return D.rfm_scores(D.numeric_features(t.customers(), t.transactions(), [t.anchor("orders")], YEARLY))


@query("text_signals", """
    SELECT customer_id, as_of_date, msg_count_7d, msg_count_30d, round(complaint_rate_30d, 6) AS complaint_rate_30d, round(avg_msg_length_30d, 6) AS avg_msg_length_30d,
           round(response_delay_mean, 6) AS response_delay_mean, round(msg_volatility, 6) AS msg_volatility FROM txt_e""", "txt_e")
def _(t):
    out = D.text_signals(t.customers(), t.trusted(), [t.anchor("events")])
    return out.select("customer_id", "as_of_date", "msg_count_7d", "msg_count_30d", *[r6(c).alias(c) for c in ("complaint_rate_30d", "avg_msg_length_30d", "response_delay_mean", "msg_volatility")])


def _series_rows(df, columns):
    """One row per window, so arrays need no comparison."""
    return df.select("customer_id", "as_of_date", F.posexplode(F.arrays_zip(*columns)).alias("idx", "z")).select(
        "customer_id", "as_of_date", "idx", *[r6(F.col(f"z.{c}")).alias(c) for c in columns])


def _dense_numeric(t):
    return D.numeric_features(t.customers(), t.purchases(), [t.anchor("events")], DENSE)


@query("windowed_series", "SELECT customer_id, as_of_date, idx, n AS tx_series, round(spend, 6) AS spend_series FROM ser_o", "ser_o")
def _(t):
    return _series_rows(D.numeric_features(t.customers(), t.transactions(), [t.anchor("orders")], YEARLY), ["tx_series", "spend_series"])


@query("windowed_series_30d", "SELECT customer_id, as_of_date, idx, n AS tx_series, round(spend, 6) AS spend_series FROM ser_o30", "ser_o30")
def _(t):
    return _series_rows(D.numeric_features(t.customers(), t.transactions(), [t.anchor("orders")]), ["tx_series", "spend_series"])


@query("windowed_series_half_open", """
    SELECT w.customer_id, w.as_of_date, w.idx, CAST(count(t.tx_id) AS DOUBLE) AS tx_series, round(CAST(coalesce(sum(t.amount), 0) AS DOUBLE), 6) AS spend_series
    FROM wins_o w LEFT JOIN transactions t ON t.customer_id = w.customer_id AND t.status = 'completed' AND CAST(t.tx_date AS DATE) >= w.d0 AND CAST(t.tx_date AS DATE) < w.d1
    WHERE w.customer_id IN (SELECT customer_id FROM transactions t2, anchor_orders a WHERE status = 'completed' AND CAST(tx_date AS DATE) BETWEEN a.as_of - 1095 AND a.as_of)
    GROUP BY 1, 2, 3""", "wins_o transactions")
def _(t):
    dates = [t.anchor("orders")]
    daily = D.daily_transactions(t.transactions(), dates[0]).withColumn("spend", F.col("cents") / 100.0)
    return _series_rows(D.windowed_series(daily, dates, YEARLY, {"tx_series": "n", "spend_series": "spend"}, "half_open"), ["tx_series", "spend_series"])


@query("windowed_message_series", """
    SELECT customer_id, as_of_date, idx, msgs AS msg_series FROM ser_e
    WHERE customer_id IN (SELECT t.customer_id FROM trusted t, anchor_events a WHERE t.day BETWEEN a.as_of - 30 AND a.as_of)""", "ser_e")
def _(t):
    dates = [t.anchor("events")]
    return _series_rows(D.windowed_series(D.daily_messages(t.trusted()), dates, DENSE, {"msg_series": "n"}), ["msg_series"])


@query("sma", "SELECT customer_id, as_of_date, idx, round(spend_s, 6) AS smoothed FROM sm_e", "sm_e")
def _(t):
    n = _dense_numeric(t)
    return _series_rows(n.withColumn("smoothed", S.sma(F.col("spend_series"), 3)), ["smoothed"])


@query("ema", """
    WITH RECURSIVE e AS (
        SELECT customer_id, as_of_date, idx, spend AS v FROM ser_e WHERE idx = 0
        UNION ALL SELECT s.customer_id, s.as_of_date, s.idx, 0.5 * s.spend + 0.5 * e.v FROM ser_e s JOIN e ON e.customer_id = s.customer_id AND e.as_of_date = s.as_of_date AND s.idx = e.idx + 1)
    SELECT customer_id, as_of_date, idx, round(v, 6) AS smoothed FROM e""", "ser_e")
def _(t):
    n = _dense_numeric(t)
    return _series_rows(n.withColumn("smoothed", S.ema(F.col("spend_series"), 0.5)), ["smoothed"])


@query("smooth", "SELECT customer_id, as_of_date, idx, round(avg(spend) OVER (PARTITION BY customer_id, as_of_date ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM ser_e", "ser_e")
def _(t):
    n = _dense_numeric(t)
    return _series_rows(n.withColumn("smoothed", S.smooth(F.col("spend_series"), FeatureConfig(smoothing_window=2))), ["smoothed"])


@query("trend_slope", "SELECT customer_id, round(regr_slope(n, idx), 6) + 0.0 AS tx_slope, round(regr_slope(spend, idx), 6) + 0.0 AS spend_slope FROM ser_e GROUP BY 1", "ser_e")
def _(t):
    return _dense_numeric(t).select("customer_id", r6(S.trend_slope(F.col("tx_series"))).alias("tx_slope"), r6(S.trend_slope(F.col("spend_series"))).alias("spend_slope"))


@query("magnitude_features", "SELECT customer_id, round(n_mean, 6) AS activity_mean, n_last AS recent_activity_avg FROM trend_e", "trend_e")
def _(t):
    return D.derived_features(_dense_numeric(t), DENSE).select("customer_id", r6("activity_mean").alias("activity_mean"), "recent_activity_avg")


@query("volatility_features", """
    SELECT customer_id, round(n_std, 6) AS activity_std, round(CASE WHEN n_mean >= 0.01 THEN least(10.0, n_std / n_mean) ELSE 0.0 END, 6) AS activity_cv,
           round(CASE WHEN s_mean >= 0.01 THEN least(10.0, s_std / s_mean) ELSE 0.0 END, 6) AS spend_volatility_cv FROM trend_e""", "trend_e")
def _(t):
    return D.derived_features(_dense_numeric(t), DENSE).select("customer_id", *[r6(c).alias(c) for c in ("activity_std", "activity_cv", "spend_volatility_cv")])


@query("safe_ratio", """
    SELECT n.customer_id, round(CAST(CASE WHEN coalesce(avg_gap, 0) = 0 THEN CASE WHEN recency_days = 0 THEN 1.0 ELSE 10.0 END ELSE least(10.0, recency_days / avg_gap) END AS DOUBLE), 6) AS recency_ratio
    FROM num_o n LEFT JOIN gap_o USING (customer_id, as_of_date)""", "num_o gap_o")
def _(t):
    n = D.numeric_features(t.customers(), t.transactions(), [t.anchor("orders")], YEARLY)
    return n.select("customer_id", r6(S.safe_ratio(F.col("recency_days").cast("double"), F.col("avg_interpurchase_days"), YEARLY)).alias("recency_ratio"))


@query("interpurchase_days", "SELECT n.customer_id, round(coalesce(avg_gap, 0), 6) AS avg_interpurchase_days FROM num_e n LEFT JOIN gap_e USING (customer_id, as_of_date)", "num_e gap_e")
def _(t):
    return _dense_numeric(t).select("customer_id", r6("avg_interpurchase_days").alias("avg_interpurchase_days"))


@query("sentiment_features", "SELECT customer_id, as_of_date, round(avg_sentiment_score, 6) + 0.0 AS avg_sentiment_score, round(sentiment_trend, 6) + 0.0 AS sentiment_trend FROM sent_e", "sent_e")
def _(t):
    dates = [t.anchor("events")]
    out = D.sentiment_features(D.customer_spine(t.customers(), dates), t.semantics(), dates, prior_days=10)
    return out.select("customer_id", "as_of_date", r6("avg_sentiment_score").alias("avg_sentiment_score"), r6("sentiment_trend").alias("sentiment_trend"))


@query("sentiment_features_as_of", """
    SELECT customer_id, a.as_of AS as_of_date, round(coalesce(cur, 0.0), 6) + 0.0 AS avg_sentiment_score,
           round(CASE WHEN cur IS NULL THEN 0.0 ELSE cur - coalesce(pri, 0.0) END, 6) + 0.0 AS sentiment_trend
    FROM customers c CROSS JOIN anchor_events a
    LEFT JOIN (SELECT customer_id, avg_sentiment_score AS cur FROM semantics, anchor_events a WHERE as_of_date <= a.as_of
               QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY as_of_date DESC) = 1) x USING (customer_id)
    LEFT JOIN (SELECT customer_id, avg_sentiment_score AS pri FROM semantics, anchor_events a WHERE as_of_date <= a.as_of - 10
               QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY as_of_date DESC) = 1) y USING (customer_id)""", "customers semantics anchor_events")
def _(t):
    dates = [t.anchor("events")]
    out = D.sentiment_features(D.customer_spine(t.customers(), dates), t.semantics(), dates, prior_days=10, current_as_of=True)
    return out.select("customer_id", "as_of_date", r6("avg_sentiment_score").alias("avg_sentiment_score"), r6("sentiment_trend").alias("sentiment_trend"))


@query("interaction", "SELECT customer_id, round(f_slope * n_mean, 6) + 0.0 AS trend_magnitude_interaction FROM trend_o", "trend_o")
def _(t):
    n = D.numeric_features(t.customers(), t.transactions(), [t.anchor("orders")], YEARLY)
    return D.derived_features(n, YEARLY).select("customer_id", r6("trend_magnitude_interaction").alias("trend_magnitude_interaction"))


@query("feature_vector", f"SELECT customer_id, as_of_date, {VECTOR_SQL} FROM vec_e", "vec_e")
def _(t):
    return rounded(dense_vector(t))


@query("feature_vector_verified", f"""SELECT customer_id, as_of_date, {VECTOR_SQL}, trusted_feedback_used, '{feature_schema_hash()}' AS feature_schema_hash,
    'v3.0.0' AS feature_service_version, 10 AS feature_window_days FROM vec_ev""", "vec_ev")
def _(t):
    return D.with_metadata(rounded(dense_vector(t, mode="verified"), ("trusted_feedback_used",)), DENSE)


@query("live_sentiment_windows", """
    SELECT customer_id, round(coalesce(avg(score) FILTER (part = 'now'), 0), 6) + 0.0 AS avg_current, round(coalesce(avg(score) FILTER (part = 'prior'), 0), 6) + 0.0 AS avg_prior
    FROM (SELECT * FROM (
        SELECT e.*, p.part FROM (SELECT event_id, user_id AS customer_id, CAST(ts AS DATE) AS day, ts, CASE event_type WHEN 'error' THEN -1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END AS score
                                 FROM events WHERE event_type NOT IN ('signup', 'purchase')) e, anchor_events a, (SELECT unnest(['now', 'prior']) AS part) p
        WHERE (p.part = 'now' AND day BETWEEN a.as_of - 10 AND a.as_of) OR (p.part = 'prior' AND day BETWEEN a.as_of - 20 AND a.as_of - 10))
      QUALIFY row_number() OVER (PARTITION BY customer_id, part ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY 1""", "anchor_events")
def _(t):
    types = t.read("events").select(F.col("event_id").alias("msg_id"), F.when(F.col("event_type") == "error", -1.0).when(F.col("event_type") == "click", 0.5).otherwise(0.0).alias("score"))
    scored = t.messages().join(types, "msg_id").withColumn("customer_id", F.col("phone_number").cast("bigint"))
    out = D.live_sentiment_windows(scored, t.anchor("events"), days=10)
    return out.select("customer_id", r6("avg_current").alias("avg_current"), r6("avg_prior").alias("avg_prior"))


_VOL_SQL = {
    "calendar": ("generate_series(0, 30)", "stddev_pop(coalesce(c.n, 0))"),
    "training": ("generate_series(1, 30)", "stddev_pop(coalesce(c.n, 0))"),
    "active": ("generate_series(0, 30)", "stddev_pop(c.n)"),
}
for _mode, (_days, _std) in _VOL_SQL.items():
    @query(f"msg_volatility_{_mode}", f"""
        SELECT s.customer_id, round({_std}, 6) AS msg_volatility
        FROM (SELECT c.customer_id, a.as_of - CAST(g AS INTEGER) AS day FROM (SELECT DISTINCT customer_id FROM trusted) c, anchor_events a, (SELECT unnest({_days}) AS g)) s
        LEFT JOIN (SELECT customer_id, day, count(*) AS n FROM trusted GROUP BY 1, 2) c ON c.customer_id = s.customer_id AND c.day = s.day GROUP BY 1 HAVING count(c.n) > 0""", "trusted anchor_events")
    def _(t, mode=_mode):
        return D.msg_volatility(D.daily_messages(t.trusted()), [t.anchor("events")], mode).select("customer_id", r6("msg_volatility").alias("msg_volatility"))


@query("feature_schema_check", f"SELECT customer_id, as_of_date, {VECTOR_SQL}, '{feature_schema_hash()}' AS feature_schema_hash FROM vec_e", "vec_e")
def _(t):
    checked = D.check_feature_schema(dense_vector(t), feature_schema_hash())
    return rounded(D.with_metadata(checked, DENSE), ("feature_schema_hash",))


@query("score_range_violations", "SELECT pred_id, churn_score FROM (SELECT event_id AS pred_id, value / 100 AS churn_score FROM events) WHERE churn_score IS NULL OR churn_score < 0 OR churn_score > 1")
def _(t):
    raw = t.read("events").select(F.col("event_id").alias("pred_id"), (F.col("value") / 100).alias("churn_score"))
    return D.score_range_violations(raw)


@query("coerce_numeric", """
    SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_discount END, 6) AS number FROM lineitem""")
def _(t):
    raw = t.read("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.concat(F.lit("["), F.format_number("l_discount", 4), F.lit("]")))
                                    .when(F.col("l_linenumber") == 2, F.format_string("%.4E", "l_discount")).when(F.col("l_linenumber") == 3, F.lit("None"))
                                    .otherwise(F.col("l_discount").cast("string")).alias("raw"))
    return raw.select("l_orderkey", "l_linenumber", r6(coerce_numeric(F.col("raw"))).alias("number"))


@query("trust_gate", """
    SELECT c.customer_id, coalesce(l.trusted, 0) AS trusted_count, coalesce(l.total, 0) AS total_count, coalesce(l.trusted, 0) > 0 AS eligible
    FROM customers c LEFT JOIN (SELECT customer_id, count(*) FILTER (link_status IN ('verified', 'probable') AND linked_at <= TIMESTAMP '2024-01-02 12:00:00') AS trusted, count(*) AS total
                                FROM links GROUP BY 1) l USING (customer_id)""", "customers links")
def _(t):
    return D.trust_gate(t.customers(), t.links(), dt.datetime(2024, 1, 2, 12))


def _stored_snapshot(t: Tables):
    """The snapshot job run twice for one folder: first for some of the customers, then for all."""
    folder = scratch_dir(t.spark, "feature-snapshots")
    inputs = (t.purchases(), t.trusted(), t.semantics(), t.anchor("events"), DENSE, 10)
    ST.run_feature_snapshot(folder, t.customers().filter("customer_id % 2 = 0"), *inputs)
    return ST.run_feature_snapshot(folder, t.customers(), *inputs)


@query("stored_feature_vector", f"SELECT customer_id, as_of_date, {VECTOR_SQL} FROM vec_e", "vec_e")
def _(t):
    """Vectors from bucketed parts, which were stored for half of the customers first."""
    root, at = scratch_dir(t.spark, "vector-inputs"), t.anchor("events")
    for customers in (t.customers().filter("customer_id % 2 = 0"), t.customers()):
        ST.store_vector_inputs(root, customers, t.purchases(), t.trusted(), t.semantics(), at, DENSE, prior_days=10, buckets=16)
    return rounded(ST.stored_feature_vector(t.spark, root, at, DENSE))


_ALL_THERE = " AND ".join(f"v.{n} IS NOT NULL" for n in FEATURE_NAMES)


@query("feature_snapshot_job", f"SELECT v.customer_id, v.as_of_date, {', '.join(f'round(v.{n}, 6) + 0.0 AS {n}' for n in FEATURE_NAMES)}, {_ALL_THERE} AS complete FROM vec_e v JOIN customers c USING (customer_id) WHERE c.is_active", "vec_e customers")
def _(t):
    return rounded(_stored_snapshot(t)[0], ("complete",))


@query("snapshot_counters", f"SELECT count(*) AS total, count(*) FILTER ({_ALL_THERE}) AS processed, count(*) FILTER (NOT ({_ALL_THERE})) AS missing FROM vec_e v JOIN customers c USING (customer_id) WHERE c.is_active", "vec_e customers")
def _(t):
    return _stored_snapshot(t)[1]


@query("feature_vector_trusted_only", f"""
    SELECT customer_id, as_of_date, {VECTOR_SQL} FROM vec_ev
    WHERE customer_id IN (SELECT customer_id FROM links WHERE link_status IN ('verified', 'probable') AND linked_at <= TIMESTAMP '2024-01-02 12:00:00')""", "vec_ev links")
def _(t):
    trusted_only = D.eligible_customers(t.customers(), t.links(), dt.datetime(2024, 1, 2, 12))
    return rounded(D.feature_vector(trusted_only, t.purchases(), t.trusted(), t.semantics(), [t.anchor("events")], DENSE, "verified", prior_days=10))


@query("drifting_customers", """
    SELECT customer_id, CAST(recency_days AS INTEGER) AS recency_days, round(recency_ratio, 6) AS recency_ratio, round(r_score, 2) AS r_score, risk_score, CASE WHEN risk_score < 0.4 THEN 'low' WHEN risk_score < 0.9 THEN 'medium' ELSE 'high' END AS risk_label
    FROM (SELECT *, greatest(0.0, 5.0 - recency_days / 36.0::DOUBLE) AS r_score, CASE WHEN tx_count_90d > 0 OR spend_90d > 0 THEN 0.0 WHEN recency_days >= 180 THEN 0.9 WHEN recency_days >= 120 THEN 0.8 WHEN recency_days >= 90 THEN 0.65 ELSE 0.0 END::DOUBLE AS risk_score FROM vec_o)
    ORDER BY risk_score DESC, recency_days DESC, customer_id LIMIT 20""", "vec_o")
def drifting_customers(t):
    """The flagship: features, inactivity floor and label; the twenty customers furthest away."""
    v = D.feature_vector(t.customers(), t.transactions(), t.trusted(), t.semantics(), [t.anchor("orders")], YEARLY)
    score = risk_floor(F.lit(0.0), F.col("recency_days"), F.col("tx_count_90d"), F.col("spend_90d"))
    scored = v.withColumns(D.rfm_columns() | {"risk_score": score})
    return scored.orderBy(F.desc("risk_score"), F.desc("recency_days"), "customer_id").limit(20).select(
        "customer_id", F.col("recency_days").cast("int").alias("recency_days"), r6("recency_ratio").alias("recency_ratio"), "r_score", "risk_score", risk_label(F.col("risk_score")).alias("risk_label"))
