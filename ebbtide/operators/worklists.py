"""Follow-up queues: risk worklist, recommendations and actions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.risk import due_state, priority_rank, urgency
from ebbtide.functions.skew import top_n
from ebbtide.operators.dashboard import last_visits, latest_predictions

# Follow-up by leading risk feature, as (features, action type, wording, notes).
RECOMMENDATIONS = (
    (("recency_days", "recency_ratio"), "call", "Hubungi personal untuk ajak booking ulang",
     "Customer sudah melewati pola kunjungan normal. Mulai dengan sapaan personal dan tawarkan jadwal yang tersedia."),
    (("frequency_trend_smoothed", "tx_count_90d", "activity_mean", "recent_activity_avg"), "call", "Kirim reminder jadwal perawatan rutin",
     "Aktivitas kunjungan menurun. Ingatkan jadwal treatment lanjutan atau paket rutin."),
    (("spend_90d", "avg_tx_value", "spend_trend_smoothed"), "promo", "Tawarkan promo atau bundling ringan",
     "Ada sinyal penurunan nilai transaksi. Tawarkan paket yang relevan dengan histori layanan."),
    (("complaint_ratio", "avg_sentiment_score", "sentiment_trend"), "call", "Follow-up keluhan sebelum promosi",
     "Ada sinyal sentimen/komplain. Prioritaskan klarifikasi pengalaman customer."),
    (("response_delay_mean",), "call", "Respon cepat dan follow-up manual",
     "Customer terdampak keterlambatan respon. Hubungi dengan respons personal."),
)
HIGH_RISK_FALLBACK = ("call", "Hubungi customer high-risk hari ini", "Customer masuk prioritas risiko tinggi. Lakukan check-in dan tawarkan jadwal ulang.")
DEFAULT_FALLBACK = ("email", "Pantau dan kirim check-in ringan", "Customer belum masuk prioritas tinggi. Lakukan check-in ringan bila diperlukan.")

# Suggestion category of each feature, with action type and wording.
SUGGESTIONS = {
    "sentiment": (("avg_sentiment_score", "complaint_ratio", "sentiment_trend"), "contact", "Tindak Lanjuti Keluhan: Sentimen negatif terdeteksi. Hubungi untuk penyelesaian."),
    "monetary": (("spend_trend_smoothed", "avg_tx_value", "spend_90d"), "offer", "Tawarkan Promo/Bundling Khusus: Ada penurunan tren pengeluaran."),
    "frequency": (("frequency_trend_smoothed", "activity_mean", "recent_activity_avg", "trend_magnitude_interaction"), "campaign", "Campaign Reaktivasi Rutin: Kirimkan pesan reminder jadwal kunjungan."),
    "recency": (("recency_ratio", "recency_days"), "contact", "Sapaan Personal (Win-back): Sudah melebihi siklus kunjungan normal."),
    "admin": (("response_delay_mean",), "internal", "Evaluasi Internal SLA: Waktu balas admin lambat. Prioritaskan respon berikutnya."),
}
NO_CATEGORY = ("review", "Lakukan review manual terhadap aktivitas pelanggan")
NO_REASON = ("none", "Pertahankan layanan baik (Routine Maintenance)")
# Standing suggestions per risk level.
RISK_LEVEL_ACTIONS = {
    "high": (("call", "Follow up via WhatsApp"), ("promo", "Tawarkan promo reactivation 20%"), ("reminder", "Jadwalkan reminder booking")),
    "medium": (("message", "Kirim pesan check-in"), ("promo", "Info promo member")),
    "low": (("none", "Customer dalam kondisi baik"),),
}
# Wording of a leading feature where no stored description exists.
REASON_LABELS = {
    "recency_days": "Sudah lama tidak berkunjung",
    "recency_ratio": "Kunjungan melewati pola biasanya",
    "frequency_trend_smoothed": "Tren frekuensi kunjungan menurun",
    "tx_count_90d": "Frekuensi transaksi 90 hari rendah",
    "spend_90d": "Nilai transaksi 90 hari rendah",
    "avg_tx_value": "Rata-rata nilai transaksi berubah",
    "complaint_ratio": "Rasio komplain meningkat",
    "avg_sentiment_score": "Sentimen pelanggan perlu diperhatikan",
    "msg_volatility": "Pola komunikasi tidak stabil",
    "response_delay_mean": "Waktu respon perlu dipercepat",
}


def recommendation(feature: Column, label: Column) -> Column:
    """Action type, wording and notes for the leading feature, by risk label where it decides nothing."""
    def advice(kind: str, text: str, notes: str) -> Column:
        return F.struct(F.lit(kind).alias("action_type"), F.lit(text).alias("label"), F.lit(notes).alias("notes"))

    chosen = None
    for features, *words in RECOMMENDATIONS:
        hit = feature.isin(*features)
        chosen = F.when(hit, advice(*words)) if chosen is None else chosen.when(hit, advice(*words))
    return chosen.when(label == "high", advice(*HIGH_RISK_FALLBACK)).otherwise(advice(*DEFAULT_FALLBACK))


def suggestions(reasons: DataFrame, predictions: DataFrame) -> DataFrame:
    """One suggestion per category hit by a prediction's reasons, in order of the reasons (``rank``)."""
    category = F.lit(None).cast("string")
    for name, (features, _, _) in SUGGESTIONS.items():
        category = F.when(F.col("feature").isin(*features), name).otherwise(category)
    ranked = reasons.withColumn("category", category).groupBy("pred_id", "category").agg(F.min("rank").alias("rank"))
    has_category = F.coalesce(F.max(F.col("category").isNotNull()), F.lit(False))
    hit = ranked.filter("category IS NOT NULL")
    state = predictions.select("pred_id").join(ranked.groupBy("pred_id").agg(has_category.alias("_cat")), "pred_id", "left")
    fallback = state.filter(F.col("_cat").isNull() | ~F.col("_cat")).select(
        "pred_id", F.when(F.col("_cat").isNull(), "none").otherwise("review").alias("category"), F.lit(1).alias("rank")
    )
    texts = {name: (kind, text) for name, (_, kind, text) in SUGGESTIONS.items()} | {"review": NO_CATEGORY, "none": NO_REASON}

    def lookup(i: int) -> Column:
        return F.element_at(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("category"))

    return hit.select("pred_id", "category", "rank").unionByName(fallback).select("pred_id", "rank", "category", lookup(0).alias("type"), lookup(1).alias("text"))


def risk_level_actions(labels: DataFrame, column: str = "churn_label") -> DataFrame:
    """The standing suggestions of each row's risk level."""
    per_level = F.create_map(*[
        x for level, items in RISK_LEVEL_ACTIONS.items()
        for x in (F.lit(level), F.array(*[F.struct(F.lit(k).alias("type"), F.lit(v).alias("text")) for k, v in items]))
    ])
    return labels.select("*", F.posexplode(F.element_at(per_level, F.col(column))).alias("position", "a")).select("*", "a.type", "a.text").drop("a")


def top_reason(contributions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per prediction the stored first reason, else the largest absolute contribution with its wording.

    A stored explanation counts only if it is one of model contributions (``explanation_type`` is "shap").
    """
    best = contributions.groupBy("pred_id").agg(
        F.max_by(F.struct("feature", "value"), F.struct(F.abs("contribution"), -F.col("slot"), F.col("value"))).alias("b")
    ).select("pred_id", "b.feature", "b.value")
    names = F.create_map(*[x for k, v in REASON_LABELS.items() for x in (F.lit(k), F.lit(v))])
    text = F.coalesce(F.try_element_at(names, F.col("feature")), F.col("feature"), F.lit("Faktor risiko utama"))
    suffix = F.when(F.col("value").isNotNull(), F.format_string(" (%.1f)", "value")).otherwise("")
    out = best.select("pred_id", F.col("feature").alias("top_feature"), F.concat(text, suffix).alias("top_reason"))
    if stored is None:
        return out
    first = stored.filter(F.col("explanation_type") == "shap").select("pred_id", F.try_element_at("shap_top", F.lit(1)).alias("f")).filter("f IS NOT NULL").select(
        "pred_id", F.col("f.feature").alias("_sf"), F.coalesce("f.description", "f.feature").alias("_sr"))
    joined = out.join(first, "pred_id", "full")
    return joined.select("pred_id", F.coalesce("_sf", "top_feature").alias("top_feature"), F.coalesce("_sr", "top_reason").alias("top_reason"))


def risk_worklist(
    predictions: DataFrame, customers: DataFrame, features: DataFrame, actions: DataFrame, transactions: DataFrame, reasons: DataFrame,
    label: str | None = None, sort: str = "score", descending: bool = True, offset: int = 0, limit: int | None = None,
) -> DataFrame:
    """Newest predictions with customer, features, last follow-up, last visit, reason, urgency and advice."""
    rows = latest_predictions(predictions)
    if label is not None:
        rows = rows.filter(F.col("churn_label") == label)
    newest_action = top_n(actions, ["customer_id"], [F.desc("created_at"), F.desc("action_id")], 1).select("customer_id", "action_id", F.col("status").alias("action_status"))
    joined = (
        rows.join(customers.select("customer_id", F.col("name").alias("_name"), F.col("city").alias("customer_city")), "customer_id", "left")
        .join(features.select("customer_id", "recency_days", "tx_count_90d", "spend_90d"), "customer_id", "left")
        .join(newest_action, "customer_id", "left")
        .join(last_visits(transactions), "customer_id", "left")
        .join(reasons, "pred_id", "left")
    )
    advice = recommendation(F.coalesce("top_feature", F.lit("")), F.col("churn_label"))
    out = joined.select(
        "pred_id", "customer_id", F.coalesce("_name", F.col("customer_id").cast("string")).alias("customer_name"), "customer_city",
        "churn_score", "churn_label", "recency_days", "tx_count_90d", "spend_90d", "last_visit", "top_feature", "top_reason",
        urgency(F.col("churn_label"), F.col("recency_days"), F.col("action_status")).alias("urgency"),
        advice["action_type"].alias("action_type"), advice["label"].alias("recommendation"), advice["notes"].alias("notes"),
        "action_id", F.coalesce("action_status", F.lit("not_started")).alias("work_status"),
    )
    key = F.col("customer_name") if sort == "name" else F.col("churn_score")
    if limit is None:
        return out
    return out.orderBy(key.desc() if descending else key.asc(), "customer_id", "pred_id").offset(offset).limit(limit)


def action_queue(
    actions: DataFrame, customer_id=None, status: str | None = None, priority: str | None = None, assigned_to: str | None = None, offset: int = 0, limit: int = 20,
) -> DataFrame:
    """One page of follow-ups, high priority and early deadline first, no deadline last."""
    found = actions
    for column, value in (("customer_id", customer_id), ("status", status), ("priority", priority), ("assigned_to", assigned_to)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    return found.orderBy(priority_rank(F.col("priority")), F.asc_nulls_last("due_date"), "action_id").offset(offset).limit(limit)


def action_stats(actions: DataFrame, today: dt.date) -> DataFrame:
    """Open, pending, running and overdue follow-ups and deadlines by distance."""
    state, status = due_state(F.col("due_date"), F.lit(today)), F.col("status")
    return actions.agg(
        F.count_if(status.isin("pending", "in_progress")).alias("open"), F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "in_progress").alias("in_progress"), F.count_if(~status.isin("completed", "cancelled") & (state == "overdue")).alias("overdue"),
        *[F.count_if(state == s).alias(f"due_{s}") for s in ("today", "soon", "later", "none")],
    )


def work_queue_stats(worklist: DataFrame) -> DataFrame:
    """Untouched and running items of a worklist."""
    return worklist.agg(F.count_if(F.col("work_status") == "not_started").alias("open_queue"), F.count_if(F.col("work_status").isin("pending", "in_progress")).alias("active_follow_ups"))
