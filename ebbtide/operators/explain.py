"""Why a score is what it is: contributions, reasons and message evidence."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import FEATURE_NAMES, NEUTRALIZED_FEATURES, TRUSTED_STATUSES, feature_schema_hash
from ebbtide.functions import vectors as V
from ebbtide.functions.skew import salted_join, top_n
from ebbtide.functions.text import truncate
from ebbtide.functions.trees import ensemble, tree_nodes
from ebbtide.session import cut_lineage

# impact = (value - offset) * factor / divisor for each feature.
HEURISTIC_IMPACTS = {
    "recency_ratio": (1, 2, 1),
    "frequency_trend_smoothed": (0, -2, 1),
    "spend_trend_smoothed": (0, -2, 1),
    "msg_trend_smoothed": (0, -2, 1),
    "sentiment_trend": (0, -3, 1),
    "recency_days": (0, 1, 30),
    "tx_count_90d": (0, -1, 3),
    "spend_90d": (0, -1, 300000),
    "avg_tx_value": (0, -1, 50000),
    "tenure_days": (0, -1, 365),
    "activity_mean": (0, -1, 3),
    "recent_activity_avg": (0, -1, 3),
    "activity_std": (0, 1, 1),
    "activity_cv": (0, 2, 1),
    "spend_volatility_cv": (0, 2, 1),
    "trend_magnitude_interaction": (0, -1, 1),
    "avg_sentiment_score": (0, -2, 1),
    "complaint_ratio": (0, 5, 1),
    "msg_volatility": (0, 1, 1),
    "response_delay_mean": (0, 1, 3600),
}

# Wording per feature. A rule is (column, comparison, bound, text); the first that
# holds is used, a rule without comparison always holds.
REASON_TEXTS = {
    "recency_ratio": (("value", ">", 2, "Sudah 2x lebih lama dari biasanya tidak bertransaksi"), ("value", ">", 1, "Lebih lama dari biasanya tidak bertransaksi"), ("", "", 0, "Masih dalam pola normal")),
    "frequency_trend_smoothed": (("value", "<", -0.5, "Tren frekuensi transaksi turun tajam"), ("value", "<", 0, "Tren frekuensi transaksi menurun"), ("", "", 0, "Tren frekuensi transaksi stabil/naik")),
    "spend_trend_smoothed": (("value", "<", -0.5, "Tren belanja turun tajam"), ("value", "<", 0, "Tren belanja menurun"), ("", "", 0, "Tren belanja stabil/naik")),
    "msg_trend_smoothed": (("value", "<", -0.5, "Tren komunikasi turun tajam"), ("value", "<", 0, "Tren komunikasi menurun"), ("", "", 0, "Tren komunikasi stabil/naik")),
    "sentiment_trend": (("value", "<", -0.2, "Sentimen memburuk signifikan"), ("value", "<", 0, "Sentimen sedikit menurun"), ("", "", 0, "Sentimen stabil/membaik")),
    "recency_days": (("contribution", ">", 0, "Sudah lama tidak bertransaksi"), ("", "", 0, "Baru saja bertransaksi")),
    "tx_count_90d": (("", "", 0, "Jumlah transaksi 90 hari terakhir"),),
    "spend_90d": (("", "", 0, "Total belanja 90 hari terakhir"),),
    "avg_tx_value": (("", "", 0, "Rata-rata nilai transaksi"),),
    "tenure_days": (("value", "<", 90, "Tenure masih pendek"), ("value", "<", 180, "Tenure relatif baru"), ("", "", 0, "Tenure panjang sebagai konteks historis")),
    "activity_mean": (("value", "<", 1, "Aktivitas sangat rendah"), ("value", "<", 3, "Aktivitas sedang"), ("", "", 0, "Aktivitas tinggi")),
    "recent_activity_avg": (("value", "=", 0, "Tidak ada aktivitas terkini"), ("value", "<", 2, "Aktivitas terkini rendah"), ("", "", 0, "Aktivitas terkini aktif")),
    "activity_std": (("value", ">", 2, "Pola aktivitas sangat tidak stabil"), ("value", ">", 0.5, "Pola aktivitas fluktuatif"), ("", "", 0, "Pola aktivitas stabil")),
    "activity_cv": (("value", ">", 1, "Volatilitas aktivitas tinggi"), ("value", ">", 0.5, "Volatilitas aktivitas sedang"), ("", "", 0, "Aktivitas konsisten")),
    "spend_volatility_cv": (("value", ">", 1, "Pola belanja sangat volatile"), ("value", ">", 0.5, "Pola belanja cukup volatile"), ("", "", 0, "Pola belanja konsisten")),
    "trend_magnitude_interaction": (("value", "<", -1, "Customer aktif dengan tren menurun tajam"), ("value", "<", 0, "Tren menurun pada customer aktif"), ("", "", 0, "Interaksi tren-aktivitas positif")),
    "avg_sentiment_score": (("value", "<", -0.2, "Sentimen negatif"), ("value", ">", 0.2, "Sentimen positif"), ("", "", 0, "Sentimen netral")),
    "complaint_ratio": (("value", ">", 0.3, "Tingkat komplain tinggi"), ("value", ">", 0.1, "Beberapa komplain"), ("", "", 0, "Sedikit/tanpa komplain")),
    "msg_volatility": (("", "", 0, "Volatilitas pola pesan"),),
    "response_delay_mean": (("contribution", ">", 0, "Waktu respons admin lambat"), ("", "", 0, "Waktu respons admin cepat")),
}
DIRECTION_TEXTS = ("meningkatkan risiko", "menurunkan risiko")

CONTRIBUTION = "array<struct<feature:string,value:double,contribution:double>>"


def _packed(names: tuple[str, ...], contribution) -> Column:
    """Features of a row as structs in schema order; ``contribution`` maps a name to a column."""
    return F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), contribution(n).alias("contribution")) for n in names
    ])


def linear_contributions(vectors: DataFrame, weights: dict[str, float]) -> DataFrame:
    """F19 for a linear model: weight * (value - mean) for each feature, exact and additive.

    The vectors are stored once, for the means and for the rows; the means are one number per feature.
    """
    vectors = cut_lineage(vectors)
    means = vectors.agg(*[F.avg(n).alias(n) for n in weights]).first()
    return vectors.withColumn("contributions", _packed(tuple(weights), lambda n: F.lit(weights[n]) * (F.col(n) - F.lit(means[n]))))


def tree_contributions(vectors: DataFrame, model: PipelineModel, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """F19 for boosted trees, exact: Shapley values by the paths of the trees, in units of the log-odds of the score.

    ``base_value`` is the log-odds expected over the training rows, and base plus contributions is the log-odds of the row's score. The
    trees are flattened once and sent to the tasks; a batch of rows is explained where it is, without copies or
    shuffles. Missing features go the way they go in scoring.
    """
    known = ensemble(tree_nodes(model.stages[-1], vectors.sparkSession))
    told = vectors.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<double>")
    def explained(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(names))
        found = 2.0 * told.value.contributions(x)  # the probability is the logistic of twice the sum of the trees
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(names)), pa.array(found.ravel()))

    packed = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names])
    index = {n: j for j, n in enumerate(names)}
    out = vectors.withColumn("_phi", explained(packed)).withColumn("contributions", _packed(names, lambda n: F.col("_phi")[index[n]]))
    return out.drop("_phi").withColumn("base_value", F.lit(2.0 * known.base))


def shapley_contributions(
    vectors: DataFrame, model: PipelineModel, key: str, names: tuple[str, ...] = FEATURE_NAMES, permutations: int = 10, seed: int = 42
) -> DataFrame:
    """F19 for a fitted model of another kind than trees: permutation-sampled Shapley values against the feature means.

    Each row is rewritten once per permutation and step, with the first ``step`` features of the
    permutation taken from the row and the rest from the means. The model scores all of them as
    one DataFrame; a step's score counts for the feature just added and against the one added
    next, so the sums per feature are the Shapley estimates and add up to score minus base score.
    Permutations come in pairs, forward and reversed.
    """
    rng, orders = random.Random(seed), []
    while len(orders) < permutations:
        order = list(range(len(names)))
        rng.shuffle(order)
        orders += [order, order[::-1]]
    orders = orders[:permutations]
    base = vectors.agg(*[F.avg(n).alias(n) for n in names]).first()
    ranks = [[order.index(j) for j in range(len(names))] for order in orders]
    added = [order + [-1] for order in orders]
    steps = (
        vectors.select(key, *names)
        .withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    )
    rank = lambda j: F.element_at(F.lit([r[j] for r in ranks]), F.col("_p") + 1)
    mixed = steps.select(key, "_p", "_k", *[F.when(rank(j) < F.col("_k"), F.col(n)).otherwise(F.lit(base[n])).alias(n) for j, n in enumerate(names)])
    prob = model.transform(mixed).select(key, "_p", "_k", vector_to_array("probability")[1].alias("score"))
    order_of = F.element_at(F.lit(added), F.col("_p") + 1)
    gains = F.filter(
        F.array(
            F.struct(F.when(F.col("_k") > 0, F.element_at(order_of, F.greatest(F.col("_k"), F.lit(1)))).otherwise(-1).alias("j"), F.col("score").alias("g")),
            F.struct(F.element_at(order_of, F.col("_k") + 1).alias("j"), (-F.col("score")).alias("g")),
        ),
        lambda s: s["j"] >= 0,
    )
    sums = prob.select(key, F.explode(gains).alias("s")).groupBy(key, F.col("s.j").alias("j")).agg((F.sum("s.g") / len(orders)).alias("phi"))
    wide = sums.groupBy(key).agg(*[F.max(F.when(F.col("j") == j, F.col("phi"))).alias(f"_c_{j}") for j in range(len(names))])
    joined = vectors.join(wide, key)
    index = {n: j for j, n in enumerate(names)}
    return joined.withColumn("contributions", _packed(names, lambda n: F.col(f"_c_{index[n]}"))).drop(*[f"_c_{j}" for j in range(len(names))])


def _value_of(contributions: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(contributions, lambda c: c["feature"] == name), F.lit(1))["value"], F.lit(0.0))


def top_reasons(rows: DataFrame, n: int = 5, neutral: tuple[str, ...] = NEUTRALIZED_FEATURES, drop_silent_ratio: bool = True) -> DataFrame:
    """the ``n`` largest absolute contributions of each row, four decimals, ties in feature order.

    Neutralised features never count, and for long-silent customers without purchases recency in
    days speaks for itself, so the derived ratio is left out. All inside the row: no shuffle.
    """
    c = F.col("contributions")
    kept = F.filter(c, lambda x: ~x["feature"].isin(*neutral)) if neutral else c
    if drop_silent_ratio:
        silent = (_value_of(c, "recency_days") >= 90) & (_value_of(c, "tx_count_90d") <= 0)
        kept = F.when(silent, F.filter(kept, lambda x: x["feature"] != "recency_ratio")).otherwise(kept)
    ordered = F.array_sort(F.transform(kept, lambda x, i: F.struct((-F.abs(x["contribution"])).alias("o"), i.alias("i"), x.alias("x"))))
    best = F.transform(F.slice(ordered, 1, n), lambda s: F.struct(
        s["x"]["feature"].alias("feature"), F.round(s["x"]["value"], 4).alias("value"), F.round(s["x"]["contribution"], 4).alias("contribution")))
    return rows.withColumn("reasons", best)


def heuristic_reasons(vectors: DataFrame, n: int = 5) -> DataFrame:
    """reasons from fixed impact formulas where no model contributions exist."""
    def impact(name: str) -> Column:
        offset, factor, divisor = HEURISTIC_IMPACTS[name]
        return F.round((F.col(name) - offset) * factor / divisor, 4)

    return top_reasons(vectors.withColumn("contributions", _packed(FEATURE_NAMES, impact)), n, neutral=(), drop_silent_ratio=False)


def reason_text(feature: Column, value: Column, contribution: Column) -> Column:
    """wording of a reason from the feature, its value and the direction of its effect."""
    operands = {"value": value, "contribution": contribution}
    compare = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}
    text = feature
    for name, rules in REASON_TEXTS.items():
        worded = None
        for column, op, bound, words in reversed(rules):
            worded = F.lit(words) if not op else F.when(compare[op](operands[column], F.lit(bound)), words).otherwise(worded)
        text = F.when(feature == name, worded).otherwise(text)
    return F.concat(text, F.lit(" ("), F.when(contribution > 0, DIRECTION_TEXTS[0]).otherwise(DIRECTION_TEXTS[1]), F.lit(")"))


def describe_reasons(rows: DataFrame) -> DataFrame:
    """reasons with wording as rows (rank, feature, value, contribution, description)."""
    keep = [c for c in rows.columns if c not in ("reasons", "contributions")]
    long = rows.select(*keep, F.posexplode("reasons").alias("pos", "r")).select(*keep, (F.col("pos") + 1).alias("rank"), "r.*")
    return long.withColumn("description", reason_text(F.col("feature"), F.col("value"), F.col("contribution")))


def nearest_messages(
    features: DataFrame, links: DataFrame, messages: DataFrame, as_of: dt.datetime, n: int = 5, query_vector: list[float] | None = None,
    statuses: tuple[str, ...] = TRUSTED_STATUSES,
) -> DataFrame:
    """per customer the trusted messages most similar to the newest one (or to a given vector).

    The newest vector is a partial aggregate; the join back to the messages splits customers with
    very many messages over several tasks, and each task keeps its best ``n`` before the shuffle.
    """
    usable = (
        features.filter(F.col("embedding").isNotNull() & (F.col("processed_at") <= F.lit(as_of).cast("timestamp_ntz"))).drop("customer_id")
        .join(links.filter(F.col("link_status").isin(*statuses)).select("link_id", "customer_id", "link_status"), "link_id")
    )
    candidates = usable.join(messages.select("msg_id"), "msg_id", "left_semi")  # texts join after the ranking, ids before
    if query_vector is None:
        newest = usable.groupBy("customer_id").agg(F.max_by("embedding", F.struct("processed_at", "feature_id")).alias("_q"))
        paired = salted_join(candidates, newest, ["customer_id"], ["feature_id"])
    else:
        paired = candidates.withColumn("_q", F.lit([float(x) for x in query_vector]))
    similarity = F.greatest(F.lit(0.0), (1 + V.cosine(F.col("embedding"), F.col("_q"))) / 2)
    best = top_n(paired.withColumn("_s", similarity), ["customer_id"], [F.desc_nulls_last("_s"), F.asc("feature_id")], n, "rank")
    return best.join(messages.select("msg_id", "text", "timestamp"), "msg_id").select(
        "customer_id", "rank", "feature_id", "link_id", "msg_id", truncate(F.col("text"), 200).alias("text_snippet"), "timestamp", "link_status",
        F.round("_s", 4).alias("similarity_score"),
    )


def explanations_table(predictions: DataFrame, reasons: DataFrame, evidence: DataFrame, version: str, as_of: dt.datetime, kind: str = "shap") -> DataFrame:
    """one row per prediction with reasons and evidence; the newest wins where one was explained twice.

    ``kind`` says how the reasons were made ("shap", or "heuristic" for F21); a column ``explanation_type`` of the reasons says it per
    prediction. Predictions without reasons have neither reasons nor a kind.
    """
    keep = [c for c in ("feature", "value", "contribution", "description") if c in reasons.columns]
    made = F.max("explanation_type") if "explanation_type" in reasons.columns else F.max(F.lit(kind))
    shap = reasons.groupBy("pred_id").agg(F.array_sort(F.collect_list(F.struct("rank", *keep))).alias("shap_top"), made.alias("explanation_type"))
    near = evidence.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "msg_id", "text_snippet", "similarity_score"))).alias("nearest_messages"))
    one = predictions.groupBy("pred_id").agg(F.max_by(F.struct("customer_id", "model_version"), "created_at").alias("p")).select("pred_id", "p.*")
    return one.join(shap, "pred_id", "left").join(near, "customer_id", "left").select(
        "pred_id", "customer_id", "shap_top", "nearest_messages", F.lit(version).alias("explainer_version"), F.lit(feature_schema_hash()).alias("feature_schema_hash"),
        "model_version", "explanation_type", F.lit(as_of).cast("timestamp_ntz").alias("as_of"),
    )
