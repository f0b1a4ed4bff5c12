"""Queries over dashboards, customer views and work queues (G)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ebbtide.functions.risk import urgency
from ebbtide.functions.skew import top_n
from ebbtide.operators import dashboard as G
from ebbtide.operators import explain as X
from ebbtide.operators import features as D
from ebbtide.operators import worklists as WL
from ebbtide.plans.bindings import DENSE, Tables, add_cte, r6
from ebbtide.plans.q_features import feature_ctes
from ebbtide.plans.q_semantics import topic_table, weekly_semantics
from ebbtide.plans.registry import query

NOW = dt.datetime(2024, 1, 31)


def snapshot_dates(t: Tables) -> list[dt.date]:
    last = t.anchor("events")
    return [last, last - dt.timedelta(7), last - dt.timedelta(14)]


feature_ctes("w", "customers anchor_events", """
    SELECT c.customer_id, c.created_at, c.is_active, a.as_of - CAST(o AS INTEGER) AS as_of_date FROM customers c, anchor_events a, (SELECT unnest([0, 7, 14]) AS o)""", "purchases", 10, 90, prior=10)


@query("latest_predictions", "SELECT * FROM latest", "latest")
def _(t):
    return G.latest_predictions(t.predictions())


@query("dashboard_stats", """
    SELECT (SELECT count(*) FROM customers WHERE is_active) AS total_customers, round(100.0 * count(*) FILTER (churn_label = 'high') / count(*), 2) AS high_risk_rate,
           count(*) FILTER (churn_label = 'high') AS high_risk_count, count(*) FILTER (churn_label = 'medium') AS medium_risk_count, count(*) FILTER (churn_label = 'low') AS low_risk_count,
           round(avg(churn_score), 3) AS avg_risk_score, (SELECT count(*) FROM predictions WHERE created_at >= TIMESTAMP '2024-01-24') AS new_predictions_7d,
           (SELECT count(*) FROM actions WHERE status = 'pending') AS pending_actions FROM latest""", "customers latest actions")
def _(t):
    return G.dashboard_stats(t.customers(), t.predictions(), t.actions(), NOW)


@query("risk_trend", """
    SELECT CAST(p.created_at AS DATE) AS date, count(*) AS total, count(*) FILTER (churn_label = 'high') AS high_risk, round(100.0 * count(*) FILTER (churn_label = 'high') / count(*), 2) AS risk_rate
    FROM latest p WHERE created_at >= TIMESTAMP '2024-01-24' GROUP BY 1""", "latest")
def _(t):
    return G.risk_trend(t.predictions(), dt.datetime(2024, 1, 24))


_DRIVERS = "SELECT feature, count(*) AS count, avg(abs(contribution)) AS m FROM contributions JOIN latest USING (pred_id) WHERE churn_label = 'high' GROUP BY 1"


@query("top_drivers", f"SELECT feature, count, round(m, 3) AS avg_contribution FROM ({_DRIVERS}) ORDER BY count DESC, feature LIMIT 10", "latest contributions")
def _(t):
    return G.top_drivers(t.predictions(), t.contributions())


@query("top_risk_driver", f"SELECT feature, round(m, 3) AS metric, count AS affected FROM ({_DRIVERS}) ORDER BY round(m, 9) DESC, feature LIMIT 1", "latest contributions")
def _(t):
    return G.top_risk_driver(t.predictions(), t.contributions())


@query("at_risk_customers", """
    SELECT l.customer_id, c.name, round(churn_score, 3) AS risk_score, churn_label AS risk_label, c.created_at AS customer_since FROM latest l JOIN customers c USING (customer_id)
    WHERE churn_label = 'high' AND c.is_active ORDER BY churn_score DESC, l.customer_id, pred_id LIMIT 10""", "latest customers")
def _(t):
    return G.at_risk_customers(t.customers(), t.predictions())


@query("sentiment_summary", "SELECT mood AS label, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM wk), 2) AS percent FROM wk GROUP BY 1", "wk")
def _(t):
    return G.sentiment_summary(weekly_semantics(t))


_GROUP = """
    SELECT {cols} FROM (SELECT DISTINCT customer_id, churn_label FROM latest WHERE churn_label IN ('high', 'low')) g JOIN {src} s USING (customer_id)"""


def _mean(label: str, column: str) -> str:
    return f"avg({column}) FILTER (churn_label = '{label}')"


def _means(columns) -> str:
    return ", ".join(f"round({_mean(g, c)}, 6) + 0.0 AS {g}_{c}" for c in columns for g in ("high", "low"))


def _rounded(df, keep=()):
    return df.select(*[r6(c).alias(c) if c not in keep else F.col(c) for c in df.columns])


@query("risk_group_recency", _GROUP.format(src="num_w", cols=_means(["recency_days", "tx_count_90d"]) + f", round({_mean('high', 'recency_days')} / {_mean('low', 'recency_days')}, 1) AS recency_ratio"), "latest num_w")
def _(t):
    return _rounded(G.risk_group_recency(t.predictions(), D.numeric_features(t.customers(), t.purchases(), snapshot_dates(t), DENSE)))


@query("risk_group_sentiment", _GROUP.format(src="semantics", cols=_means(["avg_sentiment_score"]) + f", round(({_mean('low', 'avg_sentiment_score')} - {_mean('high', 'avg_sentiment_score')}) / abs({_mean('low', 'avg_sentiment_score')}) * 100, 6) AS percent_lower"), "latest semantics")
def _(t):
    return _rounded(G.risk_group_sentiment(t.predictions(), t.semantics()))


@query("risk_group_messages", _GROUP.format(src="txt_w", cols=_means(["msg_count_30d", "complaint_rate_30d"]) + f", round(({_mean('low', 'msg_count_30d')} - {_mean('high', 'msg_count_30d')}) / {_mean('low', 'msg_count_30d')} * 100, 6) AS percent_fewer"), "latest txt_w")
def _(t):
    return _rounded(G.risk_group_messages(t.predictions(), D.text_signals(t.customers(), t.trusted(), snapshot_dates(t))))


@query("risk_distribution", "SELECT x AS risk_label, count(churn_label) AS customers FROM (SELECT unnest(['low', 'medium', 'high']) AS x) LEFT JOIN latest ON churn_label = x GROUP BY 1", "latest")
def _(t):
    return G.risk_distribution(t.predictions())


add_cte("newest", "predictions", "SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, pred_id DESC) = 1")
add_cte("visits", "transactions", "SELECT customer_id, max(tx_date) AS last_visit FROM transactions WHERE status = 'completed' GROUP BY 1")
_LIST = """
    SELECT customer_id, name, city, is_active, round(churn_score, 3) AS risk_score, churn_label AS risk_label, last_visit, total FROM (
        SELECT c.*, n.churn_score, n.churn_label, count(*) OVER () AS total, row_number() OVER (ORDER BY {order}, customer_id) AS rn FROM customers c LEFT JOIN newest n USING (customer_id) WHERE {where})
    LEFT JOIN visits USING (customer_id) WHERE rn > {skip} AND rn <= {skip} + 20"""


@query("list_customers", _LIST.format(order="name", where="(name ILIKE '%7%' OR city ILIKE '%7%') AND is_active", skip=20), "customers newest visits")
def _(t):
    return G.list_customers(t.customers(), t.predictions(), t.transactions(), search="7", is_active=True, page=2)


@query("list_customers_by_risk", _LIST.format(order="churn_score DESC NULLS LAST", where="city ILIKE '%build%'", skip=0), "customers newest visits")
def _(t):
    return G.list_customers(t.customers(), t.predictions(), t.transactions(), city="build", sort="risk_score", descending=True)


@query("list_customers_high_risk", _LIST.format(order="name", where="churn_label = 'high'", skip=0), "customers newest visits")
def _(t):
    return G.list_customers(t.customers(), t.predictions(), t.transactions(), risk_level="high")


add_cte("summary", "transactions", "SELECT customer_id, count(*) AS total_transactions, round(CAST(sum(amount) AS DOUBLE), 6) AS total_spent, max(tx_date) AS last_transaction_date FROM transactions WHERE status = 'completed' GROUP BY 1")


@query("transaction_summary", "SELECT * FROM summary", "summary")
def _(t):
    return G.transaction_summary(t.transactions()).withColumn("total_spent", r6("total_spent"))


@query("customer_360", """
    SELECT c.customer_id, c.name, n.recency_days, n.tx_count_90d, x.msg_count_30d, round(x.complaint_rate_30d, 6) AS complaint_rate_30d, d.topic_key AS dominant_topic, d.as_of_date AS semantics_date,
           s.total_transactions, s.total_spent, p.pred_id, round(p.churn_score, 6) AS churn_score, p.churn_label
    FROM customers c JOIN num_w n ON n.customer_id = c.customer_id AND n.as_of_date = (SELECT as_of FROM anchor_events) JOIN txt_w x ON x.customer_id = c.customer_id AND x.as_of_date = n.as_of_date
    LEFT JOIN (SELECT customer_id, as_of_date, topic_key FROM (SELECT customer_id, as_of_date, topic_key, count(*) AS n FROM wk GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY as_of_date DESC, n DESC, topic_key) = 1) d ON d.customer_id = c.customer_id
    LEFT JOIN summary s ON s.customer_id = c.customer_id LEFT JOIN newest p ON p.customer_id = c.customer_id""", "customers num_w txt_w anchor_events wk summary newest")
def _(t):
    dates = snapshot_dates(t)
    numeric = D.numeric_features(t.customers(), t.purchases(), dates, DENSE)
    signals = D.text_signals(t.customers(), t.trusted(), dates)
    out = G.customer_360(t.customers(), numeric, signals, weekly_semantics(t), t.transactions(), t.predictions(), dates[0])
    return out.select("customer_id", "name", "numeric_features.recency_days", "numeric_features.tx_count_90d", "text_signals.msg_count_30d",
                      r6("text_signals.complaint_rate_30d").alias("complaint_rate_30d"), "text_semantics.dominant_topic", F.col("text_semantics.as_of_date").alias("semantics_date"),
                      "transaction_summary.total_transactions", r6("transaction_summary.total_spent").alias("total_spent"), "latest_prediction.pred_id",
                      r6("latest_prediction.churn_score").alias("churn_score"), "latest_prediction.churn_label")


def _full_view(t: Tables):
    """The view with messages and explanations; a week's semantics refer to the newest messages of the week before it ends."""
    dates = snapshot_dates(t)
    weekly = weekly_semantics(t)
    said = t.messages().join(t.message_features().select("msg_id", "customer_id"), "msg_id").withColumn("as_of_date", F.to_date(F.date_trunc("week", "timestamp")))
    newest = top_n(said, ["customer_id", "as_of_date"], [F.desc("timestamp"), F.desc("msg_id")], 7)
    packed = F.array_sort(F.collect_list(F.struct("rn", "msg_id")))
    refs = newest.groupBy("customer_id", "as_of_date").agg(F.transform(packed, lambda x: F.struct(x["msg_id"].alias("msg_id"))).alias("last_n_msg_ids"))
    preds = t.predictions().withColumn("model_version", F.lit("m1"))
    reasons = t.contributions().withColumnRenamed("slot", "rank").withColumn("explanation_type", F.when(F.col("pred_id") % 5 == 0, "heuristic").otherwise("shap"))
    none = t.spark.createDataFrame([], "customer_id long, rank int, msg_id long, text_snippet string, similarity_score double")
    return G.customer_360(
        t.customers(), D.numeric_features(t.customers(), t.purchases(), dates, DENSE), D.text_signals(t.customers(), t.trusted(), dates), weekly.join(refs, ["customer_id", "as_of_date"], "left"),
        t.transactions(), t.predictions(), dates[0], t.messages(), t.message_features(), X.explanations_table(preds, reasons, none, "v1", NOW),
    )


_LAST = """(SELECT customer_id, as_of_date, mood FROM (SELECT customer_id, as_of_date, mood, count(*) AS n FROM wk GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY as_of_date DESC, n DESC, mood) = 1)"""


@query("customer_360_messages", f"""
    SELECT customer_id, list, pos, msg_id, text_snippet, mood, has_complaint FROM (
        SELECT f.customer_id, 'last' AS list, row_number() OVER (PARTITION BY f.customer_id ORDER BY m.timestamp DESC, m.msg_id DESC) AS pos, m.msg_id, m.text AS text_snippet, w.mood, f.has_complaint
        FROM message_features f JOIN messages m USING (msg_id) JOIN {_LAST} w ON w.customer_id = f.customer_id AND w.as_of_date = CAST(date_trunc('week', m.timestamp) AS DATE)
        UNION ALL SELECT f.customer_id, 'all', row_number() OVER (PARTITION BY f.customer_id ORDER BY m.timestamp DESC, m.msg_id DESC), m.msg_id, m.text, m.direction, f.has_complaint FROM message_features f JOIN messages m USING (msg_id)) x
    JOIN customers USING (customer_id) WHERE pos <= 5""", "customers messages message_features wk")
def _(t):
    view = _full_view(t)
    last = view.select("customer_id", F.lit("last").alias("list"), F.posexplode("last_messages").alias("p", "m")).select("customer_id", "list", (F.col("p") + 1).alias("pos"), "m.msg_id", "m.text_snippet", F.col("m.dominant_sentiment").alias("mood"), "m.has_complaint")
    every = view.select("customer_id", F.lit("all").alias("list"), F.posexplode("historical_messages").alias("p", "m")).select("customer_id", "list", (F.col("p") + 1).alias("pos"), "m.msg_id", "m.text_snippet", F.col("m.direction").alias("mood"), "m.has_complaint")
    return last.unionByName(every)


@query("customer_360_stats", """
    SELECT c.customer_id, coalesce(s.total_transactions, 0) AS total_transactions, coalesce(s.total_spent, 0.0) AS total_spent, s.last_transaction_date AS last_visit, coalesce(x.msg_count_30d, 0) AS message_count,
           round(coalesce(x.complaint_rate_30d, 0.0), 6) AS complaint_rate, 0.0::DOUBLE AS avg_sentiment_30, p.pred_id, coalesce(r.n > 0 AND p.pred_id % 5 <> 0, false) AS explanation_available,
           CASE WHEN r.n > 0 THEN CASE WHEN p.pred_id % 5 = 0 THEN 'heuristic' ELSE 'shap' END END AS explanation_type, CASE WHEN r.n > 0 AND p.pred_id % 5 <> 0 THEN r.n ELSE 0 END AS top_reasons, p.pred_id IS NOT NULL AS shap_cached
    FROM customers c LEFT JOIN txt_w x ON x.customer_id = c.customer_id AND x.as_of_date = (SELECT as_of FROM anchor_events) LEFT JOIN summary s ON s.customer_id = c.customer_id LEFT JOIN newest p ON p.customer_id = c.customer_id
    LEFT JOIN (SELECT pred_id, count(*) AS n FROM contributions GROUP BY 1) r ON r.pred_id = p.pred_id""", "customers txt_w anchor_events summary newest contributions")
def _(t):
    p = F.col("latest_prediction")
    return _full_view(t).select(
        "customer_id", "quick_stats.total_transactions", r6("quick_stats.total_spent").alias("total_spent"), "quick_stats.last_visit", "quick_stats.message_count", r6("quick_stats.complaint_rate").alias("complaint_rate"),
        "quick_stats.avg_sentiment_30", p["pred_id"].alias("pred_id"), F.coalesce(p["explanation_available"], F.lit(False)).alias("explanation_available"), p["explanation_type"].alias("explanation_type"),
        F.coalesce(F.size(p["top_reasons"]), F.lit(0)).alias("top_reasons"), F.coalesce(p["shap_cached"], F.lit(False)).alias("shap_cached"),
    )


@query("recent_messages", """
    SELECT f.customer_id, rn, msg_id, timestamp, direction, CASE WHEN length(text) > 6 THEN substr(text, 1, 6) || '...' ELSE text END AS text_snippet, has_complaint, has_refund_request
    FROM (SELECT f.*, m.text, m.timestamp, m.direction, row_number() OVER (PARTITION BY f.customer_id ORDER BY m.timestamp DESC, m.msg_id DESC) AS rn FROM message_features f JOIN messages m USING (msg_id)) f WHERE rn <= 5""", "messages message_features")
def _(t):
    return G.recent_messages(t.messages(), t.message_features(), snippet=6)


_TIMELINE = """
    SELECT * FROM (SELECT customer_id, item_id, type, date, description, amount, status, has_complaint, row_number() OVER (PARTITION BY customer_id ORDER BY date DESC NULLS LAST, type DESC, item_id DESC) AS rn FROM (
        SELECT customer_id, tx_id AS item_id, 'transaction' AS type, tx_date AS date, 'Transaksi: ' || service_type AS description, CAST(amount AS DOUBLE) AS amount, status, NULL::BOOLEAN AS has_complaint FROM purchases
        UNION ALL SELECT f.customer_id, feature_id, 'feedback', processed_at, text, NULL, NULL, has_complaint FROM message_features f JOIN messages m USING (msg_id))) WHERE rn <= 10"""


@query("customer_timeline", _TIMELINE, "purchases messages message_features")
def _(t):
    return G.customer_timeline(t.purchases(), t.messages(), t.message_features())


@query("daily_activity", f"SELECT customer_id, CAST(date AS DATE) AS date, count(*) FILTER (type = 'transaction') AS transactions, count(*) FILTER (type = 'feedback') AS messages, round(coalesce(sum(amount), 0), 6) AS spend FROM ({_TIMELINE}) GROUP BY 1, 2", "purchases messages message_features")
def _(t):
    return G.daily_activity(G.customer_timeline(t.purchases(), t.messages(), t.message_features())).withColumn("spend", r6("spend"))


@query("risk_history", """
    SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY rn DESC) AS position, pred_id, as_of_date, round(churn_score, 6) AS churn_score, churn_label
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY as_of_date DESC, created_at DESC, pred_id DESC) AS rn FROM predictions) WHERE rn <= 12""", "predictions")
def _(t):
    return G.risk_history(t.predictions()).withColumn("churn_score", r6("churn_score"))


@query("prediction_history", """
    SELECT p.pred_id, p.customer_id, p.created_at, p.churn_label, count(c.feature) AS contributions, round(coalesce(sum(c.contribution), 0), 6) + 0.0 AS contribution_sum
    FROM predictions p LEFT JOIN contributions c USING (pred_id) GROUP BY 1, 2, 3, 4""", "predictions contributions")
def _(t):
    h = G.prediction_history(t.predictions(), t.contributions())
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["contribution"])
    return h.select("pred_id", "customer_id", "created_at", "churn_label", F.coalesce(F.size("contributions"), F.lit(0)).alias("contributions"), r6(F.coalesce(total, F.lit(0.0))).alias("contribution_sum"))


@query("entity_stats", """
    SELECT 'customers' AS entity, 'total' AS state, count(*) AS count FROM customers UNION ALL SELECT 'customers', 'active', count(*) FROM customers WHERE is_active
    UNION ALL SELECT 'transactions', 'total', count(*) FROM transactions UNION ALL SELECT 'transactions', 'completed', count(*) FROM transactions WHERE status = 'completed'
    UNION ALL SELECT 'predictions', 'total', count(*) FROM predictions UNION ALL SELECT 'predictions', churn_label || '_risk', count(*) FROM predictions GROUP BY 2
    UNION ALL SELECT 'actions', 'total', count(*) FROM actions UNION ALL SELECT 'actions', status, count(*) FROM actions WHERE status <> 'cancelled' GROUP BY 2""", "customers transactions predictions actions")
def _(t):
    return G.entity_stats(t.customers(), t.transactions(), t.predictions(), t.actions())


@query("stage_status", """
    SELECT 'import_linking' AS stage, 'customers' AS metric, CAST(count(*) AS VARCHAR) AS value FROM customers UNION ALL SELECT 'import_linking', 'active_customers', CAST(count(*) AS VARCHAR) FROM customers WHERE is_active
    UNION ALL SELECT 'import_linking', 'transactions', CAST(count(*) AS VARCHAR) FROM purchases UNION ALL SELECT 'import_linking', 'messages', CAST(count(*) AS VARCHAR) FROM messages
    UNION ALL SELECT 'import_linking', 'linked_messages', CAST(count(*) AS VARCHAR) FROM links WHERE link_status <> 'rejected' UNION ALL SELECT 'import_linking', 'unlinked_messages', CAST(count(*) AS VARCHAR) FROM links WHERE link_status = 'rejected'
    UNION ALL SELECT 'nlp', 'processed_messages', CAST(count(*) AS VARCHAR) FROM message_features WHERE has_complaint
    UNION ALL SELECT 'nlp', 'unprocessed_linked_messages', CAST((SELECT count(*) FROM links WHERE link_status <> 'rejected') - count(*) AS VARCHAR) FROM message_features WHERE has_complaint
    UNION ALL SELECT 'nlp', 'status', 'completed' UNION ALL SELECT 'features', 'feature_snapshots_total', CAST(count(*) AS VARCHAR) FROM semantics
    UNION ALL SELECT 'features', 'latest_snapshot_as_of_date', CAST(max(as_of_date) AS VARCHAR) FROM semantics
    UNION ALL SELECT 'features', 'feature_vectors', CAST(count(*) AS VARCHAR) FROM semantics WHERE as_of_date = (SELECT max(as_of_date) FROM semantics)
    UNION ALL SELECT 'topic_model', 'topic_count', CAST(count(*) AS VARCHAR) FROM topics WHERE version = 'm1' UNION ALL SELECT 'topic_model', 'model_version', 'm1'
    UNION ALL SELECT 'scoring', 'processed', CAST(count(*) AS VARCHAR) FROM latest UNION ALL SELECT 'scoring', churn_label, CAST(count(*) AS VARCHAR) FROM latest GROUP BY 2""", "customers purchases messages links message_features semantics topics latest")
def _(t):
    return G.stage_status(t.customers(), t.purchases(), t.messages(), t.links().filter("link_status <> 'rejected'"), t.message_features().filter("has_complaint"), t.semantics(), topic_table(t), t.predictions())


# ---------------------------------------------------------------------------------------------
# Work queues
# ---------------------------------------------------------------------------------------------
def _case(pairs, column: str, default: str) -> str:
    return f"CASE {' '.join(f'WHEN {column} IN ({chr(44).join(chr(39) + f + chr(39) for f in fs)}) THEN {chr(39)}{v}{chr(39)}' for fs, v in pairs)} ELSE {default} END"


_REASON_CASE = _case([((f,), text) for f, text in WL.REASON_LABELS.items()], "feature", "feature")
add_cte("reasons", "contributions", f"""
    SELECT pred_id, feature AS top_feature, {_REASON_CASE} || ' (' || CAST(CAST(value AS DECIMAL(10,1)) AS VARCHAR) || ')' AS top_reason FROM contributions
    QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY abs(contribution) DESC, slot, value DESC) = 1""")
_FALLBACK = "CASE WHEN churn_label = 'high' THEN '{}' ELSE '{}' END"
_TYPE = _case([(fs, k) for fs, k, _, _ in WL.RECOMMENDATIONS], "top_feature", _FALLBACK.format(WL.HIGH_RISK_FALLBACK[0], WL.DEFAULT_FALLBACK[0]))
_TEXT = _case([(fs, x) for fs, _, x, _ in WL.RECOMMENDATIONS], "top_feature", _FALLBACK.format(WL.HIGH_RISK_FALLBACK[1], WL.DEFAULT_FALLBACK[1]))
_NOTES = _case([(fs, n) for fs, _, _, n in WL.RECOMMENDATIONS], "top_feature", _FALLBACK.format(WL.HIGH_RISK_FALLBACK[2], WL.DEFAULT_FALLBACK[2]))
_URGENCY = """CASE WHEN action_status IN ('pending', 'in_progress') THEN 'in_progress' WHEN churn_label = 'high' AND (recency_days IS NULL OR recency_days >= 60) THEN 'critical'
    WHEN churn_label = 'high' THEN 'high' WHEN churn_label = 'medium' THEN 'medium' ELSE 'low' END"""
add_cte("todo", "actions", "SELECT customer_id, action_id, status AS action_status FROM actions QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, action_id DESC) = 1")
add_cte("queue", "latest customers num_e todo visits reasons", f"""
    SELECT pred_id, customer_id, coalesce(c.name, CAST(customer_id AS VARCHAR)) AS customer_name, c.city AS customer_city, round(churn_score, 6) AS churn_score, churn_label, recency_days, tx_count_90d,
           round(spend_90d, 6) AS spend_90d, last_visit, top_feature, top_reason, {_URGENCY} AS urgency, {_TYPE} AS action_type, {_TEXT} AS recommendation, {_NOTES} AS notes, action_id, coalesce(action_status, 'not_started') AS work_status
    FROM latest LEFT JOIN customers c USING (customer_id) LEFT JOIN num_e USING (customer_id) LEFT JOIN todo USING (customer_id) LEFT JOIN visits USING (customer_id) LEFT JOIN reasons USING (pred_id)""")


def _worklist(t: Tables, **kw):
    numeric = D.numeric_features(t.customers(), t.purchases(), [t.anchor("events")], DENSE)
    out = WL.risk_worklist(t.predictions(), t.customers(), numeric, t.actions(), t.transactions(), WL.top_reason(t.contributions().join(WL.latest_predictions(t.predictions()).select("pred_id"), "pred_id", "left_semi")), **kw)
    return out.withColumns({"churn_score": r6("churn_score"), "spend_90d": r6("spend_90d")})


@query("risk_worklist", "SELECT * FROM queue", "queue")
def _(t):
    return _worklist(t)


@query("risk_worklist_page", "SELECT * FROM queue WHERE churn_label = 'high' ORDER BY customer_name DESC, customer_id, pred_id LIMIT 10 OFFSET 5", "queue")
def _(t):
    return _worklist(t, label="high", sort="name", offset=5, limit=10)


@query("urgency", f"SELECT pred_id, {_URGENCY} AS urgency FROM predictions LEFT JOIN num_e USING (customer_id) LEFT JOIN todo USING (customer_id)", "predictions num_e todo")
def _(t):
    numeric = D.numeric_features(t.customers(), t.purchases(), [t.anchor("events")], DENSE).select("customer_id", "recency_days")
    newest = G.top_n(t.actions(), ["customer_id"], [F.desc("created_at"), F.desc("action_id")], 1).select("customer_id", "status")
    return t.predictions().join(numeric, "customer_id", "left").join(newest, "customer_id", "left").select(
        "pred_id", urgency(F.col("churn_label"), F.col("recency_days"), F.col("status")).alias("urgency"))


@query("recommend_action", f"SELECT pred_id, top_feature, {_TYPE} AS action_type, {_TEXT} AS recommendation, {_NOTES} AS notes FROM predictions JOIN reasons USING (pred_id)", "predictions reasons")
def _(t):
    joined = t.predictions().join(WL.top_reason(t.contributions()), "pred_id")
    advice = WL.recommendation(F.col("top_feature"), F.col("churn_label"))
    return joined.select("pred_id", "top_feature", advice["action_type"].alias("action_type"), advice["label"].alias("recommendation"), advice["notes"].alias("notes"))


@query("action_suggestions", f"""
    WITH h AS (SELECT pred_id, category, min(slot) AS rank FROM (SELECT pred_id, slot, {_case([(fs, n) for n, (fs, _, _) in WL.SUGGESTIONS.items()], 'feature', 'NULL')} AS category FROM contributions) GROUP BY 1, 2),
    a AS (SELECT p.pred_id, count(h.pred_id) AS n, count(h.category) AS c FROM predictions p LEFT JOIN h USING (pred_id) GROUP BY 1),
    x AS (SELECT pred_id, rank, category FROM h WHERE category IS NOT NULL UNION ALL SELECT pred_id, 1, CASE WHEN n = 0 THEN 'none' ELSE 'review' END FROM a WHERE c = 0)
    SELECT pred_id, rank, category, {_case([((n,), k) for n, (_, k, _) in WL.SUGGESTIONS.items()] + [(('review',), WL.NO_CATEGORY[0]), (('none',), WL.NO_REASON[0])], 'category', 'NULL')} AS type,
           {_case([((n,), x) for n, (_, _, x) in WL.SUGGESTIONS.items()] + [(('review',), WL.NO_CATEGORY[1]), (('none',), WL.NO_REASON[1])], 'category', 'NULL')} AS text FROM x""", "predictions contributions")
def _(t):
    return WL.suggestions(t.contributions().withColumnRenamed("slot", "rank"), t.predictions())


@query("risk_level_actions", """
    SELECT pred_id, position, type, text FROM predictions JOIN (VALUES ('high', 0, 'call', 'Follow up via WhatsApp'), ('high', 1, 'promo', 'Tawarkan promo reactivation 20%'), ('high', 2, 'reminder', 'Jadwalkan reminder booking'),
        ('medium', 0, 'message', 'Kirim pesan check-in'), ('medium', 1, 'promo', 'Info promo member'), ('low', 0, 'none', 'Customer dalam kondisi baik')) v(churn_label, position, type, text) USING (churn_label)""", "predictions")
def _(t):
    return WL.risk_level_actions(t.predictions().select("pred_id", "churn_label")).drop("churn_label")


@query("top_reason", "SELECT pred_id, top_feature, top_reason FROM reasons", "reasons")
def _(t):
    return WL.top_reason(t.contributions())


@query("top_reason_stored", """
    SELECT pred_id, CASE WHEN s.pred_id IS NOT NULL THEN 'stored' ELSE top_feature END AS top_feature, CASE WHEN s.pred_id IS NOT NULL THEN 'as stored' ELSE top_reason END AS top_reason
    FROM reasons FULL JOIN (SELECT pred_id FROM predictions WHERE pred_id % 3 = 0) s USING (pred_id)""", "predictions reasons")
def _(t):
    """Stored explanations win where they come from the model; heuristic ones do not."""
    p = t.predictions()
    entry = F.array(F.struct(F.lit("stored").alias("feature"), F.lit("as stored").alias("description")))
    stored = p.filter("pred_id % 3 IN (0, 1)").select("pred_id", entry.alias("shap_top"), F.when(F.col("pred_id") % 3 == 0, "shap").otherwise("heuristic").alias("explanation_type"))
    return WL.top_reason(t.contributions(), stored)


@query("action_queue", """
    SELECT * FROM actions WHERE status = 'pending' ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, due_date ASC NULLS LAST, action_id LIMIT 20 OFFSET 20""", "actions")
def _(t):
    return WL.action_queue(t.actions(), status="pending", offset=20)


@query("action_stats", """
    SELECT count(*) FILTER (status IN ('pending', 'in_progress')) AS open, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress,
           count(*) FILTER (status NOT IN ('completed', 'cancelled') AND due_date < DATE '1999-06-15') AS overdue, count(*) FILTER (due_date = DATE '1999-06-15') AS due_today,
           count(*) FILTER (due_date > DATE '1999-06-15' AND due_date <= DATE '1999-06-17') AS due_soon, count(*) FILTER (due_date > DATE '1999-06-17') AS due_later, count(*) FILTER (due_date IS NULL) AS due_none FROM actions""", "actions")
def _(t):
    return WL.action_stats(t.actions(), dt.date(1999, 6, 15))


@query("work_queue_stats", "SELECT count(*) FILTER (work_status = 'not_started') AS open_queue, count(*) FILTER (work_status IN ('pending', 'in_progress')) AS active_follow_ups FROM queue", "queue")
def _(t):
    return WL.work_queue_stats(_worklist(t))
