"""Queries over training, evaluation, scoring and explanation operators (F)."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import functions as F

from ebbtide.config import FEATURE_NAMES, NEUTRALIZED_FEATURES, feature_schema_hash
from ebbtide.functions.risk import risk_floor, risk_label
from ebbtide.operators import evaluation as V
from ebbtide.operators import explain as X
from ebbtide.operators import features as D
from ebbtide.operators import search as S
from ebbtide.operators import stored as ST
from ebbtide.operators import training as TR
from ebbtide.plans.bindings import YEARLY, Tables, add_cte, r6
from ebbtide.plans.q_features import VECTOR_SQL, dense_vector, feature_ctes, rounded
from ebbtide.plans.q_ingest import vector_tables
from ebbtide.plans.registry import query
from ebbtide.session import cut_lineage
from ebbtide.sources.imports import scratch_dir

AT = dt.datetime(2024, 1, 31)

# ---------------------------------------------------------------------------------------------
# Training set
# ---------------------------------------------------------------------------------------------
add_cte("obs", "transactions anchor_orders", """
    SELECT DISTINCT CAST(d AS DATE) AS obs FROM (
        SELECT unnest(generate_series(date_trunc('month', e.earliest), CAST(a.as_of - 90 AS TIMESTAMP), INTERVAL 1 MONTH)) AS d, e.earliest FROM anchor_orders a,
               (SELECT CAST(min(tx_date) AS DATE) + 90 AS earliest FROM transactions WHERE status = 'completed') e) WHERE d >= earliest
    UNION SELECT as_of - 90 FROM anchor_orders""")
feature_ctes("t", "customers transactions obs", """
    SELECT c.customer_id, c.created_at, c.is_active, o.obs, o.obs - 1 AS as_of_date FROM customers c JOIN obs o ON CAST(c.created_at AS DATE) < o.obs
    JOIN (SELECT customer_id, CAST(min(tx_date) AS DATE) AS first_tx FROM transactions WHERE status = 'completed' GROUP BY 1) f ON f.customer_id = c.customer_id AND f.first_tx < o.obs
    WHERE c.is_active AND NOT c.is_provisional""", "transactions", 365, 90)
add_cte("tx_days", "transactions", "SELECT DISTINCT customer_id, CAST(tx_date AS DATE) AS day FROM transactions WHERE status = 'completed'")
add_cte("labels_t", "tx_days obs", """
    SELECT t.customer_id, o.obs AS observation_date, max(day) FILTER (day < o.obs) AS last_tx_before, o.obs + 90 AS outcome_date, date_diff('day', o.obs, min(day) FILTER (day >= o.obs)) AS days_to_next_tx,
           CASE WHEN count(*) FILTER (day >= o.obs AND day < o.obs + 90) > 0 THEN 0 ELSE 1 END AS churned
    FROM tx_days t, obs o GROUP BY 1, 2 HAVING count(*) FILTER (day < o.obs) > 0""")
add_cte("train", "vec_t labels_t", "SELECT v.*, l.observation_date, l.churned FROM vec_t v JOIN labels_t l ON l.customer_id = v.customer_id AND l.observation_date = v.as_of_date + 1")
add_cte("split", "train", """
    SELECT *, row_number() OVER (ORDER BY observation_date, customer_id) - 1 < least(greatest(CAST(floor(count(*) OVER () * 0.8) AS BIGINT), 1), count(*) OVER () - 1) AS is_train FROM train""")


def obs_dates(t: Tables) -> list[dt.date]:
    tx = t.transactions()
    return TR.date_list(TR.observation_dates(tx, TR.training_cutoff(tx)))


def training_frame(t: Tables):
    return TR.training_dataset(t.customers(), t.transactions(), t.trusted(), t.semantics(), obs_dates(t), YEARLY)


@query("observation_dates", "SELECT obs AS observation_date FROM obs", "obs")
def _(t):
    tx = t.transactions()
    return TR.observation_dates(tx, TR.training_cutoff(tx))


@query("churn_labels", "SELECT * FROM labels_t", "labels_t")
def _(t):
    return TR.churn_labels(t.transactions(), obs_dates(t))


@query("training_dataset", f"SELECT customer_id, as_of_date AS feature_as_of_date, observation_date, churned, {VECTOR_SQL} FROM train", "train")
def _(t):
    return training_frame(t).select("customer_id", "feature_as_of_date", "observation_date", "churned", *[r6(n).alias(n) for n in FEATURE_NAMES])


@query("time_split", "SELECT customer_id, observation_date, is_train FROM split", "split")
def _(t):
    return TR.time_split(training_frame(t)).select("customer_id", "observation_date", "is_train")


def _unpivot(src: str, keep: str = "") -> str:
    pairs = ", ".join(f"{{'feature': '{n}', 'value': {n}}}" for n in FEATURE_NAMES)
    return f"SELECT {keep} unnest([{pairs}], recursive := true) FROM {src}"


@query("medians", f"SELECT feature, round(median(value), 6) + 0.0 AS median FROM ({_unpivot('split WHERE is_train')}) GROUP BY 1", "split")
def _(t):
    split = TR.time_split(cut_lineage(training_frame(t)))
    return TR.medians(split.filter("is_train"), FEATURE_NAMES).select("feature", r6("median").alias("median"))


@query("median_impute", """
    WITH x AS (SELECT customer_id, nullif(avg_tx_value, 0) AS avg_tx_value, nullif(spend_90d, 0) AS spend_90d FROM vec_e)
    SELECT customer_id, round(coalesce(avg_tx_value, (SELECT median(avg_tx_value) FROM x)), 6) AS avg_tx_value, round(coalesce(spend_90d, (SELECT median(spend_90d) FROM x)), 6) AS spend_90d FROM x""", "vec_e")
def _(t):
    names = ("avg_tx_value", "spend_90d")
    x = dense_vector(t).select("customer_id", *[F.nullif(n, F.lit(0.0)).alias(n) for n in names])
    return TR.median_impute(x, x, names).select("customer_id", *[r6(n).alias(n) for n in names])


@query("class_weight", "SELECT count(*) FILTER (churned = 1) AS positives, count(*) FILTER (churned = 0) AS negatives, round(count(*) FILTER (churned = 0) / greatest(count(*) FILTER (churned = 1), 1), 6) AS scale_pos_weight FROM labels_t", "labels_t")
def _(t):
    return TR.class_weight(TR.churn_labels(t.transactions(), obs_dates(t))).withColumn("scale_pos_weight", r6("scale_pos_weight"))


@query("smote_class_counts", """
    SELECT CAST(recency_days < 5 AS INT) AS churned, greatest(count(*), max(CASE WHEN recency_days < 5 THEN (SELECT count(*) FILTER (recency_days >= 5) FROM vec_e) ELSE 0 END)) AS "rows",
           count(*) AS real_rows FROM vec_e GROUP BY 1""", "vec_e")
def _(t):
    """Both classes are of one size after oversampling, and no real row is lost."""
    rows = dense_vector(t).withColumn("churned", (F.col("recency_days") < 5).cast("int"))
    return TR.oversample(rows, FEATURE_NAMES).groupBy("churned").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("synthetic")).alias("real_rows"))


@query("smote_oversample")
def _(t):
    rows = dense_vector(t).withColumn("churned", (F.col("recency_days") < 5).cast("int"))
    return TR.oversample(rows, FEATURE_NAMES)


# ---------------------------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------------------------
add_cte("second", "evaluation", "SELECT doc_id, y, (score * score) * (1 - 0.5 * toxic) AS score FROM evaluation")


def _second_scores(t: Tables):
    return t.evaluation().withColumn("score", (F.col("score") * F.col("score")) * (1 - 0.5 * F.col("toxic")))


def _metrics_sql(src: str) -> str:
    return f"""
    SELECT round((tp + tn) / n, 4) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS "precision", round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 4) AS recall,
           round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1, round((rs - p * (p + 1) / 2) / (p * (n - p)), 4) AS roc_auc, round(ap, 4) AS pr_auc,
           n AS rows, p AS positives, n - p AS negatives
    FROM (SELECT count(*) AS n, sum(y) AS p, sum(y) FILTER (score >= 0.5) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 0) AS tn,
                 count(*) FILTER (score < 0.5 AND y = 1) AS fn, sum(CASE WHEN y = 1 THEN r + (c - 1) / 2.0 END) AS rs
          FROM (SELECT *, rank() OVER (ORDER BY score) AS r, count(*) OVER (PARTITION BY score) AS c FROM {src})),
         (SELECT sum(dp / tot * cp / ca) AS ap FROM (SELECT dp, sum(dp) OVER (ORDER BY score DESC) AS cp, sum(da) OVER (ORDER BY score DESC) AS ca, sum(dp) OVER () AS tot
          FROM (SELECT score, sum(y) AS dp, count(*) AS da FROM {src} GROUP BY 1)))"""


@query("classification_metrics", _metrics_sql("evaluation"), "evaluation")
def _(t):
    return V.classification_metrics(t.evaluation())


@query("threshold_sweep", """
    SELECT th AS threshold, round(CASE WHEN f = 0 THEN 0 ELSE tp / f END, 4) AS "precision", round(tp / p, 4) AS recall, round(2 * tp / (f + p), 4) AS f1_score, f AS high_risk_customers
    FROM (SELECT CAST(th AS DOUBLE) AS th, count(*) FILTER (score >= th) AS f, count(*) FILTER (score >= th AND y = 1) AS tp, sum(y) AS p FROM evaluation, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]::DOUBLE[]) AS th) GROUP BY 1)""", "evaluation")
def _(t):
    return V.threshold_sweep(t.evaluation())


@query("compare_models", f"""
    WITH a AS (UNPIVOT ({_metrics_sql('evaluation')}) ON accuracy, "precision", recall, f1, roc_auc, pr_auc INTO NAME metric VALUE v),
         b AS (UNPIVOT ({_metrics_sql('second')}) ON accuracy, "precision", recall, f1, roc_auc, pr_auc INTO NAME metric VALUE v)
    SELECT a.metric, a.v AS baseline, b.v AS multimodal, round(b.v - a.v, 4) + 0.0 AS improvement FROM a JOIN b USING (metric)""", "second")
def _(t):
    out = V.compare_models(V.classification_metrics(t.evaluation()), V.classification_metrics(_second_scores(t)))
    return out.withColumn("improvement", F.col("improvement") + 0.0)


@query("model_health", f"""
    SELECT recall, f1, roc_auc, round((recall + f1 + roc_auc) / 3, 6) AS health_score, CASE WHEN (recall + f1 + roc_auc) / 3 >= 0.75 THEN 'Baik' WHEN (recall + f1 + roc_auc) / 3 >= 0.6 THEN 'Cukup' ELSE 'Perlu Perhatian' END AS performance_status
    FROM ({_metrics_sql('second')})""", "second")
def _(t):
    return V.model_health(V.classification_metrics(_second_scores(t))).select("recall", "f1", "roc_auc", r6("health_score").alias("health_score"), "performance_status")


@query("feature_importance_fallback", "SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM contributions GROUP BY 1", "contributions")
def _(t):
    return V.contribution_importance(t.contributions()).withColumn("importance", r6("importance"))


_GROUPS = {"nlp": ("avg_sentiment_score", "sentiment_trend", "complaint_ratio"), "activity": ("activity_mean", "recent_activity_avg", "activity_std", "activity_cv", "spend_volatility_cv", "trend_magnitude_interaction")}


@query("ablation_report", f"""
    SELECT round(1 - sum(p * p), 6) AS concentration, round(100 * coalesce(sum(p) FILTER (feature IN {_GROUPS['nlp']}), 0), 6) AS nlp_percent, round(100 * coalesce(sum(p) FILTER (feature IN {_GROUPS['activity']}), 0), 6) AS activity_percent
    FROM (SELECT feature, m / sum(m) OVER () AS p FROM (SELECT feature, avg(abs(contribution)) AS m FROM contributions GROUP BY 1))""", "contributions")
def _(t):
    out = V.importance_shares(V.contribution_importance(t.contributions()), _GROUPS)
    return out.select(*[r6(c).alias(c) for c in out.columns])


# ---------------------------------------------------------------------------------------------
# Feature profiles
# ---------------------------------------------------------------------------------------------
add_cte("vec_6", "vec_e", f"SELECT customer_id, as_of_date, {VECTOR_SQL} FROM vec_e")


def _profiled(t: Tables):
    """Features with six decimals, so that sums which are zero count as zero on both sides."""
    return rounded(dense_vector(t))


def _long(t: Tables, *keep: str):
    return TR.unpivot(cut_lineage(_profiled(t)), FEATURE_NAMES, *keep)


_LONG = _unpivot("vec_6")


@query("describe_features", f"""
    SELECT feature, count(value) AS count, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.25), 6) + 0.0 AS p25,
           round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.75), 6) + 0.0 AS p75, round(max(value), 6) + 0.0 AS max FROM ({_LONG}) GROUP BY 1""", "vec_6")
def _(t):
    out = V.describe_features(_long(t))
    return out.select("feature", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("feature_histogram", f"""
    WITH l AS ({_LONG}), s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1)
    SELECT feature, CAST(CASE WHEN hi = lo THEN 15 ELSE least(floor((value - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin, count(*) AS count FROM l JOIN s USING (feature) GROUP BY 1, 2""", "vec_6")
def _(t):
    return V.histogram(_long(t))


@query("group_comparison", f"""
    WITH l AS ({_unpivot("vec_6", "CASE WHEN recency_days > (SELECT median(recency_days) FROM vec_6) THEN 1 ELSE 0 END AS label,")}),
    g AS (SELECT feature, avg(value) FILTER (label = 0) AS low_mean, avg(value) FILTER (label = 1) AS high_mean, stddev_samp(value) FILTER (label = 0) AS low_std, stddev_samp(value) FILTER (label = 1) AS high_std FROM l GROUP BY 1)
    SELECT feature, round(low_mean, 6) + 0.0 AS low_mean, round(high_mean, 6) + 0.0 AS high_mean, round(low_std, 6) + 0.0 AS low_std, round(high_std, 6) + 0.0 AS high_std,
           round((high_mean - low_mean) / nullif(low_mean, 0) * 100, 4) + 0.0 AS diff_pct FROM g""", "vec_6")
def _(t):
    marked = V.proxy_label(cut_lineage(_profiled(t)))
    out = V.group_comparison(TR.unpivot(marked, FEATURE_NAMES, "label"))
    return out.select("feature", *[r6(c).alias(c) for c in ("low_mean", "high_mean", "low_std", "high_std")], (F.round("diff_pct", 4) + 0.0).alias("diff_pct"))


_CORR = f"""
    WITH l AS (SELECT customer_id, feature, value, list_position({list(FEATURE_NAMES)}, feature) AS i FROM ({_unpivot("vec_6", "customer_id,")}))
    SELECT feature_1, feature_2, round(c, 4) AS correlation FROM (SELECT a.feature AS feature_1, b.feature AS feature_2, corr(a.value, b.value) AS c FROM l a JOIN l b ON b.customer_id = a.customer_id AND a.i < b.i GROUP BY 1, 2)
    WHERE c IS NOT NULL AND NOT isnan(c) AND abs(c) > LIMIT_HERE"""
for _name, _limit in (("correlations", 0.95), ("correlations_moderate", 0.5)):
    @query(_name, _CORR.replace("LIMIT_HERE", str(_limit)), "vec_6")
    def _(t, limit=_limit):
        return V.correlations(_profiled(t), FEATURE_NAMES, limit).withColumn("correlation", F.round("correlation", 4))


@query("edge_cases", f"""
    WITH l AS ({_LONG}), s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY 1)
    SELECT feature, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value = 0) AS zero, count(*) FILTER (feature IN ('activity_cv', 'spend_volatility_cv') AND value >= 9.99) AS capped,
           count(*) FILTER (s > 0 AND abs(value - m) > 3 * s) AS outliers FROM l JOIN s USING (feature) GROUP BY 1""", "vec_6")
def _(t):
    return V.edge_cases(_long(t))


# ---------------------------------------------------------------------------------------------
# Scores and labels
# ---------------------------------------------------------------------------------------------
@query("neutralize_features", f"SELECT customer_id, as_of_date, {VECTOR_SQL.replace('round(tenure_days, 6) + 0.0 AS tenure_days', '0.0::DOUBLE AS tenure_days')} FROM vec_e", "vec_e")
def _(t):
    return TR.neutralize(dense_vector(t)).select("customer_id", "as_of_date", *[r6(n).alias(n) for n in FEATURE_NAMES])


@query("risk_floor", """
    SELECT customer_id, round(greatest(0.5 / (1 + tenure_days / 365.0), CASE WHEN tx_count_90d > 0 OR spend_90d > 0 THEN 0 WHEN recency_days >= 180 THEN 0.9 WHEN recency_days >= 120 THEN 0.8 WHEN recency_days >= 90 THEN 0.65 ELSE 0 END), 6) AS churn_score FROM num_o""", "num_o")
def _(t):
    n = D.numeric_features(t.customers(), t.transactions(), [t.anchor("orders")], YEARLY)
    score = F.lit(0.5) / (1 + F.col("tenure_days") / 365.0)
    return n.select("customer_id", r6(risk_floor(score, F.col("recency_days"), F.col("tx_count_90d"), F.col("spend_90d"))).alias("churn_score"))


@query("risk_label", "SELECT event_id, CASE WHEN value / 100 < 0.4 THEN 'low' WHEN value / 100 < 0.9 THEN 'medium' ELSE 'high' END AS risk_label FROM events")
def _(t):
    return t.read("events").select("event_id", risk_label(F.col("value") / 100).alias("risk_label"))


@query("prediction_provenance", f"""
    SELECT v.customer_id, v.as_of_date, round(p.churn_score, 6) AS churn_score, p.churn_label, '{feature_schema_hash()}' AS feature_schema_hash, 'm1' AS model_version, 'abc' AS model_hash, trusted_feedback_used,
           round(recency_ratio, 6) AS first_feature, 20 AS features FROM vec_e v JOIN newest p USING (customer_id)""", "vec_e newest")
def _(t):
    from ebbtide.operators.dashboard import newest_prediction

    scored = dense_vector(t).withColumn("features_used", F.array(*FEATURE_NAMES)).join(newest_prediction(t.predictions()).select("customer_id", "churn_score", "churn_label"), "customer_id")
    out = TR.provenance(scored, TR.ModelInfo("m1", "abc"), AT)
    return out.select("customer_id", "as_of_date", r6("churn_score").alias("churn_score"), "churn_label", "feature_schema_hash", "model_version", "model_hash", "trusted_feedback_used",
                      r6(F.col("features_used")[0]).alias("first_feature"), F.size("features_used").alias("features"))


# ---------------------------------------------------------------------------------------------
# Explanations
# ---------------------------------------------------------------------------------------------
WEIGHTS = {n: round((-1) ** i * 0.013 * (i + 3), 6) for i, n in enumerate(FEATURE_NAMES)}
add_cte("contrib", "vec_e", "SELECT customer_id, unnest([" + ", ".join(
    f"{{'i': {i}, 'feature': '{n}', 'value': {n}, 'contribution': {w}::DOUBLE * ({n} - avg_{n})}}" for i, (n, w) in enumerate(WEIGHTS.items())
) + "], recursive := true), recency_days, tx_count_90d FROM (SELECT *, " + ", ".join(f"avg({n}) OVER () AS avg_{n}" for n in FEATURE_NAMES) + " FROM vec_e)")


def _explained(t: Tables):
    return X.linear_contributions(dense_vector(t), WEIGHTS)


@query("feature_contributions", "SELECT customer_id, feature, round(value, 6) + 0.0 AS value, round(contribution, 6) + 0.0 AS contribution FROM contrib", "contrib")
def _(t):
    return _explained(t).select("customer_id", F.explode("contributions").alias("c")).select("customer_id", "c.feature", r6("c.value").alias("value"), r6("c.contribution").alias("contribution"))


add_cte("top5", "contrib", f"""
    SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, i) AS rank, feature, CAST(round(CAST(value AS DECIMAL(24,9)), 4) AS DOUBLE) + 0.0 AS value, round(contribution, 4) + 0.0 AS contribution FROM contrib
    WHERE feature NOT IN ('{NEUTRALIZED_FEATURES[0]}') AND NOT (feature = 'recency_ratio' AND recency_days >= 90 AND tx_count_90d <= 0) QUALIFY rank <= 5""")


def _reason_rows(rows):
    return rows.select("customer_id", F.posexplode("reasons").alias("pos", "r")).select("customer_id", (F.col("pos") + 1).alias("rank"), "r.feature", (F.col("r.value") + 0.0).alias("value"), (F.col("r.contribution") + 0.0).alias("contribution"))


@query("top_reasons", "SELECT * FROM top5", "top5")
def _(t):
    return _reason_rows(X.top_reasons(_explained(t)))


_IMPACTS = ", ".join(f"{{'i': {i}, 'feature': '{n}', 'value': {n}, 'contribution': round(({n} - {o}) * ({f}) / {d}.0::DOUBLE, 4)}}" for i, (n, (o, f, d)) in enumerate(X.HEURISTIC_IMPACTS.items()))


@query("heuristic_reasons", f"""
    SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, i) AS rank, feature, CAST(round(CAST(value AS DECIMAL(24,9)), 4) AS DOUBLE) + 0.0 AS value, round(contribution, 4) + 0.0 AS contribution
    FROM (SELECT customer_id, unnest([{_IMPACTS}], recursive := true) FROM vec_e) QUALIFY rank <= 5""", "vec_e")
def _(t):
    return _reason_rows(X.heuristic_reasons(dense_vector(t)))


def _rule_sql(rules) -> str:
    whens = " ".join(f"WHEN {c} {op} {b} THEN '{x}'" for c, op, b, x in rules if op)
    last = f"'{rules[-1][3]}'"
    return f"CASE {whens} ELSE {last} END" if whens else last


_DESCRIBE = "CASE feature " + " ".join(f"WHEN '{n}' THEN {_rule_sql(r)}" for n, r in X.REASON_TEXTS.items()) + " END || CASE WHEN contribution > 0 THEN ' (meningkatkan risiko)' ELSE ' (menurunkan risiko)' END"


@query("describe_reasons", f"SELECT customer_id, rank, feature, {_DESCRIBE} AS description FROM top5", "top5")
def _(t):
    return X.describe_reasons(X.top_reasons(_explained(t)).select("customer_id", "reasons")).select("customer_id", "rank", "feature", "description")


def evidence(t: Tables, query_vector=None):
    links, feats, _ = vector_tables(t)
    feats = feats.select(F.col("link_id").alias("feature_id"), "link_id", F.col("link_id").alias("msg_id"), "embedding", "processed_at")
    docs = t.read("documents").select(F.col("doc_id").alias("msg_id"), "text", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").alias("timestamp"))
    newest = feats.agg(F.max("processed_at")).first()[0]
    return X.nearest_messages(feats, links, docs, newest, query_vector=query_vector)


add_cte("near", "vectors", """
    SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, link_id) AS rank, link_id AS msg_id, link_status, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text_snippet, round(s, 4) AS similarity_score
    FROM (SELECT v.*, greatest(0, (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2) AS s FROM vectors v
          JOIN (SELECT customer_id, embedding FROM vectors WHERE embedding IS NOT NULL AND link_status IN ('verified', 'probable') QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY link_id DESC) = 1) q USING (customer_id)
          WHERE v.embedding IS NOT NULL AND v.link_status IN ('verified', 'probable')) JOIN documents ON doc_id = link_id QUALIFY rank <= 5""")


@query("nearest_messages", "SELECT * FROM near", "near")
def _(t):
    return evidence(t).select("customer_id", "rank", "msg_id", "link_status", "text_snippet", "similarity_score")


def _asked(t: Tables) -> list[float]:
    """The vector of the first trusted message."""
    links, feats, _ = vector_tables(t)
    trusted = feats.filter("embedding IS NOT NULL").join(links.filter("link_status IN ('verified', 'probable')").select("link_id"), "link_id", "left_semi")
    return trusted.orderBy("link_id").first()["embedding"]


@query("global_nearest_messages", """
    SELECT row_number() OVER (ORDER BY s DESC, link_id) AS rank, customer_id, link_id AS msg_id, link_status, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text_snippet, round(s, 4) AS similarity_score
    FROM (SELECT v.*, greatest(0, (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2) AS s FROM vectors v,
              (SELECT embedding FROM vectors WHERE embedding IS NOT NULL AND link_status IN ('verified', 'probable') ORDER BY link_id LIMIT 1) q
          WHERE v.embedding IS NOT NULL AND v.link_status IN ('verified', 'probable')) JOIN documents ON doc_id = link_id QUALIFY rank <= 20""", "vectors")
def _(t):
    links, feats, _ = vector_tables(t)
    feats = feats.select(F.col("link_id").alias("feature_id"), "link_id", F.col("link_id").alias("msg_id"), "embedding", "processed_at")
    docs = t.read("documents").select(F.col("doc_id").alias("msg_id"), "text", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").alias("timestamp"))
    path = scratch_dir(t.spark, "vector-index")
    S.build_vector_index(S.message_vectors(feats, links, docs), path)
    newest = feats.agg(F.max("processed_at")).first()[0]
    found, _ = S.global_nearest_messages(t.spark, path, docs, _asked(t), newest, 20)
    return found.select("rank", "customer_id", "msg_id", "link_status", "text_snippet", "similarity_score")


@query("explanations_table", """
    WITH r AS (SELECT pred_id, feature, row_number() OVER (PARTITION BY pred_id ORDER BY slot, feature, value, contribution) AS rank FROM contributions)
    SELECT p.pred_id, p.customer_id, r.feature AS first_feature, coalesce(c.n, 0) AS reasons, coalesce(e.n, 0) AS messages, round(e.best, 4) AS best_similarity, 'v1' AS explainer_version
    FROM predictions p LEFT JOIN r ON r.pred_id = p.pred_id AND r.rank = 1 LEFT JOIN (SELECT pred_id, count(*) AS n FROM r GROUP BY 1) c ON c.pred_id = p.pred_id
    LEFT JOIN (SELECT customer_id, count(*) AS n, max(similarity_score) AS best FROM near GROUP BY 1) e ON e.customer_id = p.customer_id""", "predictions contributions near")
def _(t):
    preds = t.predictions().withColumn("model_version", F.lit("m1"))
    reasons = t.contributions().withColumnRenamed("slot", "rank")
    out = X.explanations_table(preds.unionByName(preds), reasons, evidence(t), "v1", AT)
    return out.select("pred_id", "customer_id", F.try_element_at("shap_top", F.lit(1))["feature"].alias("first_feature"), F.coalesce(F.size("shap_top"), F.lit(0)).alias("reasons"),
                      F.coalesce(F.size("nearest_messages"), F.lit(0)).alias("messages"), F.array_max(F.transform("nearest_messages", lambda m: m["similarity_score"])).alias("best_similarity"), "explainer_version")


@query("store_explanations", """
    WITH r AS (SELECT pred_id, count(*) AS n, min(feature) AS low, max(feature) AS high, sum(CAST(round(contribution * 10000) AS BIGINT)) AS total FROM contributions GROUP BY 1)
    SELECT p.pred_id, p.customer_id, coalesce(r.n, 0) AS reasons, r.low AS first_feature, r.high AS last_feature, r.total, coalesce(e.n, 0) AS messages, CASE WHEN p.pred_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS explainer_version,
           CASE WHEN r.n IS NULL THEN NULL WHEN p.pred_id % 3 = 0 THEN 'heuristic' ELSE 'shap' END AS explanation_type, 'm1' AS model_version, TIMESTAMP '2024-01-31' AS as_of
    FROM predictions p LEFT JOIN r USING (pred_id) LEFT JOIN (SELECT customer_id, count(*) AS n FROM near GROUP BY 1) e ON e.customer_id = p.customer_id""", "predictions contributions near")
def _(t):
    """Explanations stored for all predictions, then a third of them explained anew by the other kind."""
    preds, folder, near = t.predictions().withColumn("model_version", F.lit("m1")), scratch_dir(t.spark, "explanations"), evidence(t)
    reasons = t.contributions().withColumnRenamed("slot", "rank")
    ST.store_explanations(X.explanations_table(preds, reasons, near, "v1", AT), folder)
    out = ST.store_explanations(X.explanations_table(preds.filter("pred_id % 3 = 0"), reasons, near, "v2", AT, "heuristic"), folder)
    features = F.transform("shap_top", lambda r: r["feature"])
    total = F.aggregate("shap_top", F.lit(0).cast("long"), lambda a, r: a + F.round(r["contribution"] * 10000).cast("long"))
    return out.select("pred_id", "customer_id", F.coalesce(F.size("shap_top"), F.lit(0)).alias("reasons"), F.array_min(features).alias("first_feature"), F.array_max(features).alias("last_feature"), total.alias("total"),
                      F.coalesce(F.size("nearest_messages"), F.lit(0)).alias("messages"), "explainer_version", "explanation_type", "model_version", "as_of")


# ---------------------------------------------------------------------------------------------
# Models (no SQL form)
# ---------------------------------------------------------------------------------------------
TREES = 100


@lru_cache(maxsize=4)
def _fitted(app: str, sf_dir: str, files: tuple, spark):
    t = Tables(spark, sf_dir)
    split = TR.time_split(cut_lineage(training_frame(t)))
    return split, TR.train_risk_model(split.filter("is_train"), trees=TREES)


def fitted(t: Tables):
    """Split training rows and the model fitted on them, once per session and state of the files."""
    meta = [t.read(n).agg(F.max("_metadata.file_modification_time"), F.sum("_metadata.file_size"), F.count(F.lit(1))).first() for n in ("orders", "customer", "events")]
    return _fitted(t.spark.sparkContext.applicationId, t.sf_dir, tuple(map(tuple, meta)), t.spark)


@query("train_risk_model")
def _(t):
    split, model = fitted(t)
    return V.classification_metrics(TR.model_scores(model, split.filter("NOT is_train")).select(F.col("churned").alias("y"), "score"))


@query("feature_importance_total", "SELECT 20 AS features, 1.0::DOUBLE AS total, true AS none_negative FROM (SELECT count(*) FROM orders)")
def _(t):
    found = t.spark.createDataFrame(TR.feature_importance(fitted(t)[1]), "feature string, importance double")
    return found.agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative"))


@query("score_customers_checked", "SELECT customer_id, true AS in_range, true AS above_floor, true AS label_fits FROM customers WHERE is_active", "customers")
def _(t):
    """One score per active customer, within 0 and 1, not below the floor of silent customers, with the label of its range."""
    vectors = D.feature_vector(t.customers().filter("is_active"), t.transactions(), t.trusted(), t.semantics(), [t.anchor("orders")], YEARLY)
    scored = TR.score_customers(vectors, fitted(t)[1], TR.ModelInfo("gbt-1", "local"), AT)
    score, used = F.col("churn_score"), F.col("features_used")
    at = lambda name: used[FEATURE_NAMES.index(name)]
    floor = risk_floor(F.lit(0.0), at("recency_days"), at("tx_count_90d"), at("spend_90d"))
    label = F.when(score < 0.4, "low").when(score < 0.9, "medium").otherwise("high")
    return scored.select("customer_id", score.between(0, 1).alias("in_range"), (score >= floor).alias("above_floor"), (F.col("churn_label") == label).alias("label_fits"))


@query("feature_importance")
def _(t):
    return t.spark.createDataFrame(TR.feature_importance(fitted(t)[1]), "feature string, importance double")


@query("score_customers")
def _(t):
    active = t.customers().filter("is_active")
    vectors = D.feature_vector(active, t.transactions(), t.trusted(), t.semantics(), [t.anchor("orders")], YEARLY)
    return TR.score_customers(vectors, fitted(t)[1], TR.ModelInfo("gbt-1", "local"), AT)


@query("score_distribution")
def _(t):
    vectors = D.feature_vector(t.customers().filter("is_active"), t.transactions(), t.trusted(), t.semantics(), [t.anchor("orders")], YEARLY)
    return TR.score_distribution(TR.score_customers(vectors, fitted(t)[1], TR.ModelInfo("gbt-1", "local"), AT))


@query("shapley_contributions")
def _(t):
    vectors = D.feature_vector(t.customers().filter("is_active"), t.transactions(), t.trusted(), t.semantics(), [t.anchor("orders")], YEARLY)
    explained = X.tree_contributions(TR.neutralize(vectors), fitted(t)[1])
    return X.describe_reasons(X.top_reasons(explained).select("customer_id", "reasons"))


@query("ablation_auc")
def _(t):
    split, model = fitted(t)
    return TR.ablation_auc(split.filter("is_train"), split.filter("NOT is_train"), trees=TREES, full=model)


@query("retrain_job")
def _(t):
    return TR.retrain(training_frame(t), trees=TREES)
