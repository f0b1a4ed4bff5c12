"""Model tables derived from the given tables, as DataFrames and as the same SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import FeatureConfig
from ebbtide.operators import features as feat

# The events table spans one month, so its queries use three windows of ten days.
DENSE = FeatureConfig(window_size_days=10)
# The orders table spans years with few orders per customer: three windows of a year.
YEARLY = FeatureConfig(window_size_days=365)

LINE_FEATURES = ["recency_ratio", "recency_days", "spend_90d", "complaint_ratio", "response_delay_mean", "activity_mean", "tenure_days"]


def r6(column: Column | str) -> Column:
    """Six decimals, and no negative zero, for comparison."""
    if isinstance(column, str):
        return F.expr(f"round({column}, 6) + 0D")
    return F.round(column, 6) + 0.0


class Tables:
    """The given parquet tables and the model tables bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._read = spark, sf_dir, {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    # -- customers and purchases ---------------------------------------------------------------
    def customers(self) -> DataFrame:
        first = self.read("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
        return self.read("customer").join(first, F.expr("c_custkey = o_custkey"), "left").selectExpr(
            "c_custkey AS customer_id", "c_name AS name", "c_mktsegment AS city", "c_acctbal >= -900 AS is_active",
            "c_acctbal < 0 AS is_provisional", "created_at", "concat('08', lpad(CAST(c_custkey AS STRING), 12, '0')) AS phone",
        )

    def transactions(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey AS tx_id", "o_custkey AS customer_id", "o_orderdate AS tx_date", "o_orderpriority AS service_type",
            "CAST(o_totalprice AS DECIMAL(12,2)) AS amount",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled' ELSE 'refunded' END AS status",
        )

    def purchases(self) -> DataFrame:
        return self.read("events").filter("event_type = 'purchase'").selectExpr(
            "event_id AS tx_id", "user_id AS customer_id", "ts AS tx_date", "'purchase' AS service_type",
            "CAST(value AS DECIMAL(12,2)) AS amount", "'completed' AS status",
        )

    # -- message signals from events -------------------------------------------------------------
    def _signals(self) -> DataFrame:
        return self.read("events").filter("event_type <> 'purchase'")

    def messages(self) -> DataFrame:
        return self._signals().selectExpr(
            "event_id AS msg_id", "CAST(user_id AS STRING) AS phone_number", "ts AS timestamp",
            "CASE WHEN event_type = 'signup' THEN 'outbound' ELSE 'inbound' END AS direction", "props AS text",
        )

    def links(self) -> DataFrame:
        return self._signals().selectExpr(
            "event_id * 10 AS link_id", "event_id AS msg_id", "user_id AS customer_id",
            "CASE WHEN event_id % 4 < 2 THEN 1D WHEN event_id % 4 = 2 THEN 0.6D ELSE 0D END AS match_confidence",
            "CASE WHEN event_id % 4 < 2 THEN 'phone_exact' ELSE 'phone_provisional' END AS match_method",
            "CASE event_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'probable' WHEN 2 THEN 'provisional' ELSE 'rejected' END AS link_status",
            "ts AS linked_at",
        )

    def message_features(self) -> DataFrame:
        return self._signals().selectExpr(
            "event_id * 10 + 1 AS feature_id", "event_id * 10 AS link_id", "event_id AS msg_id", "user_id AS customer_id",
            "event_type = 'error' AS has_complaint", "contains(props, '7') AS has_refund_request", "CAST(floor(value) AS INT) AS msg_length",
            "CASE WHEN event_type <> 'view' THEN CAST(floor(value * 3) AS INT) END AS response_time_secs",
            "ts + INTERVAL 90 MINUTES AS processed_at",
        )

    def trusted(self) -> DataFrame:
        return feat.trusted_messages(self.messages(), self.links(), self.message_features())

    def semantics(self) -> DataFrame:
        """One snapshot per customer and active day; days with more than five events carry no score."""
        e = self.read("events")
        score = F.avg(F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0))
        return e.groupBy(F.col("user_id").alias("customer_id"), F.to_date("ts").alias("as_of_date")).agg(
            F.when(F.count(F.lit(1)) <= 5, score).alias("avg_sentiment_score")
        )

    # -- message texts from conversations ---------------------------------------------------------
    def chats(self) -> DataFrame:
        """Messages with a direction: what users and assistants say."""
        return self.texts().filter("direction IS NOT NULL")

    def texts(self) -> DataFrame:
        """All turns; conversations begin in one of the hours of 90 days, so that any window grows with the data."""
        c = self.read("conversations")
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id % 2160 AS INT), CAST(turn AS INT), 0)")
        return c.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("conv_id").alias("customer_id"),
            F.when(F.col("role") == "user", "inbound").when(F.col("role") == "assistant", "outbound").alias("direction"), "text", at.alias("timestamp"),
            F.concat(F.lit("08"), F.lpad((F.col("conv_id") * 20).cast("string"), 12, "0")).alias("phone"),
        )

    # -- predictions, explanations, actions -------------------------------------------------------
    def predictions(self) -> DataFrame:
        score = F.least(F.lit(1.0), F.col("value") / 100)
        return self.read("events").select(
            F.col("event_id").alias("pred_id"), F.col("user_id").alias("customer_id"), score.alias("churn_score"),
            F.when(score < 0.4, "low").when(score < 0.9, "medium").otherwise("high").alias("churn_label"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("created_at"), F.to_date("ts").alias("as_of_date"),
        )

    def contributions(self) -> DataFrame:
        """One row per prediction and feature: an order's line numbers play the features."""
        feature = F.element_at(F.array(*[F.lit(n) for n in LINE_FEATURES]), F.col("l_linenumber"))
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("pred_id"), F.col("l_linenumber").alias("slot"), feature.alias("feature"),
            F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("contribution"), F.col("l_quantity").alias("value"),
        )

    def actions(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.read("orders").filter("o_orderstatus = 'O'").select(
            key.alias("action_id"), F.col("o_custkey").alias("customer_id"),
            F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "high").when(F.substring("o_orderpriority", 1, 1) == "3", "medium").otherwise("low").alias("priority"),
            F.when(key % 4 == 0, "pending").when(key % 4 == 1, "in_progress").when(key % 4 == 2, "completed").otherwise("cancelled").alias("status"),
            F.when(key % 10 != 0, F.date_add(F.to_date("o_orderdate"), 7)).alias("due_date"), F.col("o_orderdate").alias("created_at"),
        )

    def evaluation(self) -> DataFrame:
        l, d = self.read("labels"), self.read("documents").select("doc_id", "n_chars", "source", "lang")
        return l.join(d, "doc_id").select(
            "doc_id", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"), "toxic", "source", "lang"
        )

    def anchor(self, kind: str) -> dt.date:
        if kind == "orders":
            return feat.anchor_date(self.transactions())
        if kind == "events":
            return feat.anchor_date(self.purchases(), self.messages())
        return self.chats().agg(F.max(F.to_date("timestamp")).alias("d")).first()["d"]


# The same bindings as SQL common table expressions, each listing what it needs first.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "customers": ((), """
        SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS city, c_acctbal >= -900 AS is_active,
               c_acctbal < 0 AS is_provisional, m.created_at, '08' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS phone
        FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY 1) m ON m.o_custkey = c_custkey"""),
    "transactions": ((), """
        SELECT o_orderkey AS tx_id, o_custkey AS customer_id, o_orderdate AS tx_date, o_orderpriority AS service_type,
               CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled' ELSE 'refunded' END AS status FROM orders"""),
    "purchases": ((), """
        SELECT event_id AS tx_id, user_id AS customer_id, ts AS tx_date, 'purchase' AS service_type,
               CAST(value AS DECIMAL(12,2)) AS amount, 'completed' AS status FROM events WHERE event_type = 'purchase'"""),
    "messages": ((), """
        SELECT event_id AS msg_id, CAST(user_id AS VARCHAR) AS phone_number, ts AS timestamp,
               CASE WHEN event_type = 'signup' THEN 'outbound' ELSE 'inbound' END AS direction, props AS text
        FROM events WHERE event_type <> 'purchase'"""),
    "links": ((), """
        SELECT event_id * 10 AS link_id, event_id AS msg_id, user_id AS customer_id,
               CASE WHEN event_id % 4 < 2 THEN 1.0 WHEN event_id % 4 = 2 THEN 0.6 ELSE 0.0 END::DOUBLE AS match_confidence,
               CASE WHEN event_id % 4 < 2 THEN 'phone_exact' ELSE 'phone_provisional' END AS match_method,
               CASE event_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'probable' WHEN 2 THEN 'provisional' ELSE 'rejected' END AS link_status,
               ts AS linked_at FROM events WHERE event_type <> 'purchase'"""),
    "message_features": ((), """
        SELECT event_id * 10 + 1 AS feature_id, event_id * 10 AS link_id, event_id AS msg_id, user_id AS customer_id,
               event_type = 'error' AS has_complaint, contains(props, '7') AS has_refund_request,
               CAST(floor(value) AS INTEGER) AS msg_length,
               CASE WHEN event_type <> 'view' THEN CAST(floor(value * 3) AS INTEGER) END AS response_time_secs,
               ts + INTERVAL 90 MINUTE AS processed_at FROM events WHERE event_type <> 'purchase'"""),
    "trusted": (("messages", "links", "message_features"), """
        SELECT l.customer_id, m.msg_id, m.timestamp, CAST(m.timestamp AS DATE) AS day, f.has_complaint, f.msg_length, f.response_time_secs
        FROM message_features f JOIN links l ON l.link_id = f.link_id JOIN messages m ON m.msg_id = f.msg_id
        WHERE l.link_status IN ('verified', 'probable')"""),
    "semantics": ((), """
        SELECT user_id AS customer_id, CAST(ts AS DATE) AS as_of_date,
               CASE WHEN count(*) <= 5 THEN avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END) END AS avg_sentiment_score
        FROM events GROUP BY 1, 2"""),
    "texts": ((), """
        SELECT conv_id * 1000 + turn AS msg_id, conv_id AS customer_id, CASE role WHEN 'user' THEN 'inbound' WHEN 'assistant' THEN 'outbound' END AS direction,
               text, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 2160 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS timestamp,
               '08' || lpad(CAST(conv_id * 20 AS VARCHAR), 12, '0') AS phone
        FROM conversations"""),
    "chats": (("texts",), "SELECT * FROM texts WHERE direction IS NOT NULL"),
    "predictions": ((), """
        SELECT event_id AS pred_id, user_id AS customer_id, least(1.0, value / 100) AS churn_score,
               CASE WHEN least(1.0, value / 100) < 0.4 THEN 'low' WHEN least(1.0, value / 100) < 0.9 THEN 'medium' ELSE 'high' END AS churn_label,
               CAST(date_trunc('hour', ts) AS TIMESTAMP) AS created_at, CAST(ts AS DATE) AS as_of_date FROM events"""),
    "latest": (("predictions",), """
        SELECT p.* FROM predictions p JOIN (SELECT customer_id, max(created_at) AS m FROM predictions GROUP BY 1) x
        ON x.customer_id = p.customer_id AND x.m = p.created_at"""),
    "contributions": ((), f"""
        SELECT l_orderkey AS pred_id, l_linenumber AS slot, {LINE_FEATURES!r}[l_linenumber] AS feature,
               round(l_discount - l_tax, 4) AS contribution, l_quantity AS value FROM lineitem"""),
    "actions": ((), """
        SELECT o_orderkey AS action_id, o_custkey AS customer_id,
               CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS priority,
               CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'cancelled' END AS status,
               CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + 7 END AS due_date, o_orderdate AS created_at
        FROM orders WHERE o_orderstatus = 'O'"""),
    "evaluation": ((), """
        SELECT l.doc_id, l.quality AS y, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS score, l.toxic, d.source, d.lang
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""),
    "anchor_orders": (("transactions",), "SELECT CAST(max(tx_date) AS DATE) AS as_of FROM transactions WHERE status = 'completed'"),
    "anchor_events": ((), "SELECT CAST(max(ts) AS DATE) AS as_of FROM events"),
    "anchor_chats": (("chats",), "SELECT CAST(max(timestamp) AS DATE) AS as_of FROM chats"),
}


def add_cte(name: str, needs: str, sql: str) -> None:
    _CTES[name] = (tuple(needs.split()), sql)


def with_ctes(names: str, sql: str) -> str:
    """Put the named model tables (and what they need) in front of ``sql`` as one WITH clause."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done:
            return
        needs, body = _CTES[name]
        for need in needs:
            visit(need)
        done[name] = body

    for name in names.split():
        visit(name)
    if not done:
        return sql
    head = ",\n".join(f"{name} AS ({body})" for name, body in done.items())
    text = sql.lstrip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{text[len('WITH RECURSIVE '):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"
