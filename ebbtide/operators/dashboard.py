"""Risk KPIs, trends, drivers and customer views over stored predictions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.skew import latest_with_ties, top_n
from ebbtide.functions.text import truncate
from ebbtide.operators.semantics import dominant

RISK_LABELS = ("low", "medium", "high")
MOODS = ("positive", "neutral", "negative")


def _is_high() -> Column:
    return F.col("churn_label") == "high"


def _n() -> Column:
    return F.count(F.lit(1))


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """G1: every prediction made at the newest time of its customer; rows made at once all stay."""
    return latest_with_ties(predictions, ["customer_id"], F.desc("created_at"))


def newest_prediction(predictions: DataFrame) -> DataFrame:
    """One prediction per customer: newest, then largest id."""
    return top_n(predictions, ["customer_id"], [F.desc("created_at"), F.desc("pred_id")], 1).drop("rn")


def dashboard_stats(customers: DataFrame, predictions: DataFrame, actions: DataFrame, now: dt.datetime) -> DataFrame:
    """The headline numbers as one row."""
    active = customers.filter("is_active").agg(_n().alias("n")).scalar()
    fresh = predictions.filter(F.col("created_at") >= F.lit(now - dt.timedelta(days=7)).cast("timestamp_ntz")).agg(_n().alias("n")).scalar()
    pending = actions.filter("status = 'pending'").agg(_n().alias("n")).scalar()
    counts = latest_predictions(predictions).agg(
        *[F.count_if(F.col("churn_label") == label).alias(f"{label}_risk_count") for label in RISK_LABELS], F.avg("churn_score").alias("mean")
    )
    total = F.col("low_risk_count") + F.col("medium_risk_count") + F.col("high_risk_count")
    return counts.select(
        active.alias("total_customers"),
        F.round(F.coalesce(F.try_divide(F.col("high_risk_count") * 100.0, total), F.lit(0.0)), 2).alias("high_risk_rate"),
        "high_risk_count", "medium_risk_count", "low_risk_count",
        F.round(F.coalesce("mean", F.lit(0.0)), 3).alias("avg_risk_score"), fresh.alias("new_predictions_7d"), pending.alias("pending_actions"),
    )


def risk_trend(predictions: DataFrame, since: dt.datetime) -> DataFrame:
    """Newest predictions since a time, per day: total, high and rate."""
    recent = latest_predictions(predictions.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")))
    per_day = recent.groupBy(F.to_date("created_at").alias("date")).agg(_n().alias("total"), F.count_if(_is_high()).alias("high_risk"))
    return per_day.withColumn("risk_rate", F.round(F.col("high_risk") * 100.0 / F.col("total"), 2)).orderBy("date")


def _high_risk_contributions(predictions: DataFrame, contributions: DataFrame) -> DataFrame:
    high = latest_predictions(predictions).filter(_is_high()).select("pred_id")
    return contributions.join(high, "pred_id").groupBy("feature").agg(_n().alias("count"), F.avg(F.abs("contribution")).alias("mean_abs"))


def top_drivers(predictions: DataFrame, contributions: DataFrame, n: int = 10) -> DataFrame:
    """The features most often behind a high risk and their mean absolute contribution."""
    found = _high_risk_contributions(predictions, contributions)
    return found.select("feature", "count", F.round("mean_abs", 3).alias("avg_contribution")).orderBy(F.desc("count"), "feature").limit(n)


def top_risk_driver(predictions: DataFrame, contributions: DataFrame) -> DataFrame:
    """The feature with the largest mean absolute contribution among high risks."""
    found = _high_risk_contributions(predictions, contributions)
    return found.orderBy(F.desc(F.round("mean_abs", 9)), "feature").limit(1).select("feature", F.round("mean_abs", 3).alias("metric"), F.col("count").alias("affected"))


def at_risk_customers(customers: DataFrame, predictions: DataFrame, n: int = 10) -> DataFrame:
    """Active customers whose newest label is high, by score."""
    high = latest_predictions(predictions).filter(_is_high())
    joined = high.join(customers.filter("is_active").select("customer_id", "name", F.col("created_at").alias("customer_since")), "customer_id")
    best = joined.orderBy(F.desc("churn_score"), "customer_id", "pred_id").limit(n)
    return best.select("customer_id", "name", F.round("churn_score", 3).alias("risk_score"), F.col("churn_label").alias("risk_label"), "customer_since")


def sentiment_summary(semantics: DataFrame) -> DataFrame:
    """Message counts and shares of the three moods over all snapshots."""
    moods = semantics.select(F.explode("sentiment_dist").alias("label", "n")).filter(F.col("label").isin(*MOODS))
    sums = moods.agg(*[F.coalesce(F.sum(F.when(F.col("label") == m, F.col("n"))), F.lit(0)).alias(m) for m in MOODS])
    total = reduce(lambda a, b: a + b, [F.col(m) for m in MOODS])
    rows = F.array(*[F.struct(F.lit(m).alias("label"), F.col(m).alias("count"), F.round(F.coalesce(F.try_divide(F.col(m) * 100.0, total), F.lit(0.0)), 2).alias("percent")) for m in MOODS])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def risk_group_means(predictions: DataFrame, snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Means over every snapshot of the high and low risk customers, as high_<c> and low_<c>.

    Snapshots are summed per customer first; a customer whose newest rows carry both labels
    belongs to both groups.
    """
    groups = latest_predictions(predictions).filter(F.col("churn_label").isin("high", "low")).select("customer_id", "churn_label").distinct()
    sums = snapshots.groupBy("customer_id").agg(*[a for c in columns for a in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))])
    joined = groups.join(sums, "customer_id")
    aggs = []
    for label in ("high", "low"):
        mine = F.col("churn_label") == label
        aggs += [F.try_divide(F.sum(F.when(mine, F.col(f"s_{c}"))).cast("double"), F.sum(F.when(mine, F.col(f"n_{c}")))).alias(f"{label}_{c}") for c in columns]
    return joined.agg(*aggs)


def risk_group_recency(predictions: DataFrame, numeric: DataFrame) -> DataFrame:
    """Mean recency and purchases of high against low risk, and how many times longer."""
    m = risk_group_means(predictions, numeric, ["recency_days", "tx_count_90d"])
    return m.withColumn("recency_ratio", F.when(F.col("low_recency_days") > 0, F.round(F.col("high_recency_days") / F.col("low_recency_days"), 1)))


def risk_group_sentiment(predictions: DataFrame, semantics: DataFrame) -> DataFrame:
    """Mean sentiment of high against low risk and by how many percent it is lower."""
    m = risk_group_means(predictions, semantics, ["avg_sentiment_score"])
    low, high = F.col("low_avg_sentiment_score"), F.col("high_avg_sentiment_score")
    return m.withColumn("percent_lower", F.when(low == 0, 0.0).otherwise((low - high) / F.abs(low) * 100))


def risk_group_messages(predictions: DataFrame, signals: DataFrame) -> DataFrame:
    """Mean messages and complaint rate of high against low risk."""
    m = risk_group_means(predictions, signals, ["msg_count_30d", "complaint_rate_30d"])
    low, high = F.col("low_msg_count_30d"), F.col("high_msg_count_30d")
    return m.withColumn("percent_fewer", F.when(low > 0, (low - high) / low * 100).otherwise(0.0))


def risk_distribution(predictions: DataFrame) -> DataFrame:
    """Newest label counts, labels without customers as 0."""
    one = latest_predictions(predictions).agg(*[F.count_if(F.col("churn_label") == label).alias(label) for label in RISK_LABELS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("risk_label"), F.col(x).alias("customers")) for x in RISK_LABELS])).alias("r")).select("r.*")


def last_visits(transactions: DataFrame) -> DataFrame:
    return transactions.filter("status = 'completed'").groupBy("customer_id").agg(F.max("tx_date").alias("last_visit"))


def list_customers(
    customers: DataFrame, predictions: DataFrame, transactions: DataFrame, search: str | None = None, city: str | None = None,
    is_active: bool | None = None, risk_level: str | None = None, sort: str = "name", descending: bool = False, page: int = 1, limit: int = 20,
    most: int = 100,
) -> DataFrame:
    """One page of customers with newest risk and last visit; the total rides along.

    A page has ``limit`` rows, 20 where none is asked for, and never more than ``most``.
    """
    found = customers
    if search:
        found = found.filter(F.col("name").ilike(f"%{search}%") | F.col("city").ilike(f"%{search}%"))
    if city:
        found = found.filter(F.col("city").ilike(f"%{city}%"))
    if is_active is not None:
        found = found.filter(F.col("is_active") == is_active)
    risk = newest_prediction(predictions).select("customer_id", "churn_score", "churn_label")
    found = found.join(risk, "customer_id", "left")
    if risk_level:
        found = found.filter(F.col("churn_label") == risk_level)
    total = found.agg(_n().alias("n")).scalar()
    if sort == "risk_score":
        order = F.desc_nulls_last("churn_score") if descending else F.asc_nulls_last("churn_score")
    else:
        order = F.desc("name") if descending else F.asc("name")
    limit = min(most, limit if limit > 0 else 20)
    shown = found.orderBy(order, "customer_id").offset((max(page, 1) - 1) * limit).limit(limit)
    return shown.join(last_visits(transactions), "customer_id", "left").select(
        "customer_id", "name", "city", "is_active", F.round("churn_score", 3).alias("risk_score"), F.col("churn_label").alias("risk_label"), "last_visit", total.alias("total")
    )


def transaction_summary(transactions: DataFrame) -> DataFrame:
    """Completed purchases per customer."""
    return transactions.filter("status = 'completed'").groupBy("customer_id").agg(
        _n().alias("total_transactions"), F.sum("amount").cast("double").alias("total_spent"), F.max("tx_date").alias("last_transaction_date")
    )


def latest_snapshot(snapshots: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """The snapshot at ``as_of`` where there is one, else the newest, per customer."""
    columns = [c for c in snapshots.columns if c != "customer_id"]
    preferred = F.col("as_of_date") == F.lit(as_of) if as_of else F.lit(False)
    best = snapshots.groupBy("customer_id").agg(F.max_by(F.struct(*columns), F.struct(preferred, F.col("as_of_date"))).alias("s"))
    return best.select("customer_id", "s.*")


def _listed(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """A few ranked rows per customer as one list."""
    packed = F.array_sort(F.collect_list(F.struct("rn", *columns)))
    return rows.groupBy("customer_id").agg(F.transform(packed, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


def last_messages(semantics: DataFrame, messages: DataFrame, features: DataFrame, n: int = 5, snippet: int = 100) -> DataFrame:
    """The first ``n`` messages that a semantics row refers to, where they have features: (customer_id, rn, msg_id, text_snippet, ...).

    Messages have no mood of their own there; they carry the dominant one of their customer.
    """
    mine = semantics.select("customer_id", "dominant_sentiment", F.posexplode(F.slice("last_n_msg_ids", 1, n)).alias("rn", "m")).select("customer_id", "dominant_sentiment", "rn", F.col("m.msg_id").alias("msg_id"))
    known = features.select("msg_id", "has_complaint").join(messages.select("msg_id", "text"), "msg_id")
    return mine.join(known, "msg_id").select(
        "customer_id", "rn", "msg_id", truncate(F.coalesce("text", F.lit("")), snippet).alias("text_snippet"), "dominant_sentiment", F.col("dominant_sentiment").alias("sentiment_label"), "has_complaint"
    )


def explained_prediction(predictions: DataFrame, explanations: DataFrame) -> DataFrame:
    """The newest prediction per customer with what is stored to explain it. Reasons count only if they come from the model."""
    kept = explanations.select("pred_id", "shap_top", "nearest_messages", "explanation_type")
    joined = newest_prediction(predictions).join(kept.withColumn("_c", F.lit(True)), "pred_id", "left")
    available = F.coalesce((F.col("explanation_type") == "shap") & (F.size("shap_top") > 0), F.lit(False))
    return joined.withColumns({
        "top_reasons": F.when(available, F.col("shap_top")), "explanation_available": available,
        "explanation_status": F.when(available, "available").otherwise("SHAP explanation belum tersedia"), "shap_cached": F.coalesce("_c", F.lit(False)),
    }).drop("shap_top", "_c")


def quick_stats(view: DataFrame) -> Column:
    """The headline numbers of a customer from the parts of the view, 0 where there are none."""
    bought, signals, told = F.col("transaction_summary"), F.col("text_signals"), F.col("text_semantics")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    mood = zero(told["avg_sentiment_score"]) if "avg_sentiment_score" in view.schema["text_semantics"].dataType.names else F.lit(0.0)
    return F.struct(
        F.coalesce(bought["total_transactions"], F.lit(0)).alias("total_transactions"), zero(bought["total_spent"]).alias("total_spent"), bought["last_transaction_date"].alias("last_visit"),
        F.coalesce(signals["msg_count_30d"], F.lit(0)).alias("message_count"), zero(signals["complaint_rate_30d"]).alias("complaint_rate"), mood.alias("avg_sentiment_30"),
    )


def customer_360(
    customers: DataFrame, numeric: DataFrame, signals: DataFrame, semantics: DataFrame, transactions: DataFrame, predictions: DataFrame, as_of: dt.date,
    messages: DataFrame | None = None, features: DataFrame | None = None, explanations: DataFrame | None = None,
) -> DataFrame:
    """Profile, features, signals, semantics, purchases, risk and quick stats, one nested row per customer.

    With ``messages`` and ``features`` also the newest messages of all times (G15) and, where semantics refer to messages, the last ones of
    their window; with ``explanations`` (F24) the prediction says why. Lists are of a few messages per customer,
    trimmed before the shuffle; a customer without any has no list.
    """
    def nested(df: DataFrame, name: str) -> DataFrame:
        return df.select("customer_id", F.struct(*[c for c in df.columns if c != "customer_id"]).alias(name))

    told = semantics.withColumn("_has", F.col("sentiment_dist").isNotNull() | F.col("top_topic_counts").isNotNull())
    columns = [c for c in semantics.columns if c != "customer_id"]
    best = told.groupBy("customer_id").agg(F.max_by(F.struct(*columns), F.struct("_has", "as_of_date")).alias("s")).select("customer_id", "s.*")
    best = best.withColumns({"dominant_topic": dominant(F.col("top_topic_counts")), "dominant_sentiment": dominant(F.col("sentiment_dist"))})
    risk = newest_prediction(predictions) if explanations is None else explained_prediction(predictions, explanations)
    parts = [
        nested(latest_snapshot(numeric, as_of), "numeric_features"), nested(latest_snapshot(signals, as_of), "text_signals"), nested(best, "text_semantics"),
        nested(transaction_summary(transactions), "transaction_summary"), nested(risk, "latest_prediction"),
    ]
    if messages is not None and features is not None:
        if "last_n_msg_ids" in semantics.columns:
            parts.append(_listed(last_messages(best, messages, features), "last_messages", ["msg_id", "text_snippet", "dominant_sentiment", "sentiment_label", "has_complaint"]))
        parts.append(_listed(recent_messages(messages, features), "historical_messages", ["msg_id", "timestamp", "direction", "text_snippet", "has_complaint", "has_refund_request"]))
    view = reduce(lambda a, b: a.join(b, "customer_id", "left"), parts, customers)
    return view.withColumn("quick_stats", quick_stats(view))


def recent_messages(messages: DataFrame, features: DataFrame, n: int = 5, snippet: int = 140) -> DataFrame:
    """The newest messages per customer with a snippet and flags."""
    joined = features.select("msg_id", "customer_id", "has_complaint", "has_refund_request").join(messages.select("msg_id", "text", "timestamp", "direction"), "msg_id")
    newest = top_n(joined, ["customer_id"], [F.desc("timestamp"), F.desc("msg_id")], n)
    return newest.withColumn("text_snippet", truncate(F.coalesce("text", F.lit("")), snippet)).drop("text")


def customer_timeline(transactions: DataFrame, messages: DataFrame, features: DataFrame, n: int = 10) -> DataFrame:
    """Newest purchases and messages per customer in one list, undated items last.

    Messages are dated by when they were processed.
    """
    order = [F.desc_nulls_last("date"), F.desc("item_id")]
    bought = top_n(transactions.withColumnsRenamed({"tx_date": "date", "tx_id": "item_id"}), ["customer_id"], order, n).select(
        "customer_id", "item_id", F.lit("transaction").alias("type"), "date", F.concat(F.lit("Transaksi: "), F.coalesce("service_type", F.lit("Unknown"))).alias("description"),
        F.col("amount").cast("double").alias("amount"), "status", F.lit(None).cast("boolean").alias("has_complaint"),
    )
    heard = features.select("feature_id", "msg_id", "customer_id", "has_complaint", "processed_at").withColumnsRenamed({"processed_at": "date", "feature_id": "item_id"})
    heard = top_n(heard, ["customer_id"], order, n).join(messages.select("msg_id", "text"), "msg_id").select(
        "customer_id", "item_id", F.lit("feedback").alias("type"), "date", truncate(F.col("text"), 100).alias("description"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("status"), "has_complaint",
    )
    return top_n(bought.unionByName(heard), ["customer_id"], [F.desc_nulls_last("date"), F.desc("type"), F.desc("item_id")], n)


def daily_activity(timeline: DataFrame) -> DataFrame:
    """Purchases, messages and spend per customer and day of a timeline."""
    tx = F.col("type") == "transaction"
    return timeline.filter("date IS NOT NULL").groupBy("customer_id", F.to_date("date").alias("date")).agg(
        F.count_if(tx).alias("transactions"), F.count_if(~tx).alias("messages"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("spend")
    )


def risk_history(predictions: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` predictions per customer, numbered oldest first."""
    last = top_n(predictions, ["customer_id"], [F.desc("as_of_date"), F.desc("created_at"), F.desc("pred_id")], n)
    kept = last.groupBy("customer_id").agg(F.max("rn").alias("_k"))
    return last.join(kept, "customer_id").select("customer_id", (F.col("_k") - F.col("rn") + 1).alias("position"), "pred_id", "as_of_date", "churn_score", "churn_label")


def prediction_history(predictions: DataFrame, contributions: DataFrame, customer_id: int | str | None = None) -> DataFrame:
    """Predictions with their contributions, newest first; all customers or one."""
    mine = predictions if customer_id is None else predictions.filter(F.col("customer_id") == customer_id)
    packed = contributions.groupBy("pred_id").agg(F.array_sort(F.collect_list(F.struct("slot", "feature", "value", "contribution"))).alias("contributions"))
    return mine.join(packed, "pred_id", "left").orderBy("customer_id", F.desc("created_at"), F.desc("pred_id"))


def entity_stats(customers: DataFrame, transactions: DataFrame, predictions: DataFrame, actions: DataFrame) -> DataFrame:
    """Totals and totals by state, as (entity, state, count) rows."""
    def rows(name: str, df: DataFrame, states: dict[str, Column]) -> DataFrame:
        one = df.agg(_n().alias("total"), *[F.count_if(c).alias(s) for s, c in states.items()])
        return one.select(F.lit(name).alias("entity"), F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("count")) for s in ("total", *states)])).alias("r")).select("entity", "r.*")

    status = F.col("status")
    return reduce(DataFrame.unionByName, [
        rows("customers", customers, {"active": F.col("is_active")}),
        rows("transactions", transactions, {"completed": status == "completed"}),
        rows("predictions", predictions, {f"{x}_risk": F.col("churn_label") == x for x in RISK_LABELS}),
        rows("actions", actions, {s: status == s for s in ("pending", "in_progress", "completed")}),
    ])


def stage_status(
    customers: DataFrame, transactions: DataFrame, messages: DataFrame, links: DataFrame, features: DataFrame, snapshots: DataFrame, topics: DataFrame,
    predictions: DataFrame,
) -> DataFrame:
    """Progress of every processing stage, as (stage, metric, value) rows with text values."""
    def rows(stage: str, one: DataFrame) -> DataFrame:
        entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one.columns]
        return one.select(F.lit(stage).alias("stage"), F.explode(F.array(*entries)).alias("r")).select("stage", "r.*")

    def size(df: DataFrame) -> Column:
        return df.agg(_n().alias("n")).scalar()

    raw, linked, featured = size(messages), size(links), size(features)
    imported = customers.agg(_n().alias("customers"), F.count_if("is_active").alias("active_customers")).select(
        "*", size(transactions).alias("transactions"), raw.alias("messages"), linked.alias("linked_messages"), F.greatest(raw - linked, F.lit(0)).alias("unlinked_messages"))
    signals = features.agg(_n().alias("processed_messages")).select(
        "processed_messages", F.greatest(linked - F.col("processed_messages"), F.lit(0)).alias("unprocessed_linked_messages"),
        F.when(F.col("processed_messages") > 0, "completed").otherwise("pending").alias("status"))
    newest = snapshots.agg(_n().alias("feature_snapshots_total"), F.max("as_of_date").alias("latest_snapshot_as_of_date"))
    at_newest = snapshots.groupBy("as_of_date").agg(_n().alias("n")).agg(F.max_by("n", "as_of_date").alias("n")).scalar()
    newest = newest.withColumn("feature_vectors", at_newest)
    version = topics.agg(F.max_by("model_version", F.struct("created_at", "topic_id")).alias("v")).scalar()
    topic_rows = topics.filter(F.col("model_version") == version).agg(_n().alias("topic_count"), F.max("model_version").alias("model_version"))
    dist = latest_predictions(predictions).agg(_n().alias("processed"), *[F.count_if(F.col("churn_label") == x).alias(x) for x in RISK_LABELS])
    return reduce(DataFrame.unionByName, [
        rows("import_linking", imported), rows("nlp", signals), rows("features", newest), rows("topic_model", topic_rows), rows("scoring", dist),
    ])
