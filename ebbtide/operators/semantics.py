"""Sentiment, topics and keywords of message texts per customer, and their summaries (E operators)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import MIN_LINK_CONFIDENCE
from ebbtide.functions import vectors as V
from ebbtide.functions.skew import top_n
from ebbtide.functions.text import any_contains, words
from ebbtide.operators.messages import extract_message_features

LABELS = ("positive", "neutral", "negative")
# Our stand-in scorer counts these words; pass a scorer to use a trained model instead.
POSITIVE_WORDS = ("bagus", "puas", "senang", "nyaman", "ramah", "mantap", "suka", "terbaik", "cepat", "bersih")
NEGATIVE_WORDS = ("kecewa", "buruk", "jelek", "lambat", "telat", "kasar", "rusak", "mahal", "kotor", "parah")

# Frequent words that are no keywords.
STOP_WORDS = ("yang", "di", "dan", "ke", "dari", "ini", "itu", "untuk", "dengan", "adalah", "saya", "aku", "kamu", "dia")
# Complaint types and the fragments that reveal them.
COMPLAINT_TYPES = {
    "refund": ("refund", "uang kembali", "balikin"),
    "delivery": ("lambat", "telat", "lama", "kirim"),
    "product": ("rusak", "cacat", "jelek"),
    "service": ("pelayanan", "staff", "kasar"),
}
# Topic labels in order of preference and their keywords.
TOPIC_LABELS = (
    ("Reservasi & Jadwal", ("booking", "reservasi", "jadwal", "slot", "besok", "sabtu", "minggu", "jam")),
    ("Pijat Bayi", ("pijat", "bayi", "baby", "spa", "treatment")),
    ("Konsultasi Bayi", ("usia", "bulan", "pilek", "rewel", "aman", "mandi", "tidur")),
    ("Harga & Paket", ("harga", "biaya", "paket", "promo", "mahal")),
    ("Pengalaman Positif", ("enak", "nyaman", "sabar", "mantap", "bagus", "terima", "kasih", "makasih")),
    ("Keluhan Layanan", ("telat", "lama", "kecewa", "kurang", "buruk", "komplain")),
)

Scorer = Callable[[list[str]], list[tuple[str, float]]]


def bare_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def score_sentiment(messages: DataFrame, positive: tuple[str, ...] = POSITIVE_WORDS, negative: tuple[str, ...] = NEGATIVE_WORDS) -> DataFrame:
    """Label and valence in [-1, 1] by word counts, blank texts neutral."""
    hits = bare_words(F.coalesce("text", F.lit("")))
    good = F.size(F.filter(hits, lambda w: w.isin(*positive)))
    bad = F.size(F.filter(hits, lambda w: w.isin(*negative)))
    score = F.round(F.coalesce(F.try_divide((good - bad).cast("double"), good + bad), F.lit(0.0)), 4)
    return messages.withColumn("sentiment_score", score).withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def score_sentiment_with(messages: DataFrame, make_scorer: Callable[[], Scorer], batch: int = 32) -> DataFrame:
    """E1 with an injected model: it sees batches of non-blank texts and gives (label, valence).

    ``make_scorer`` loads the model; each task calls it once.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            labels, scores = ["neutral"] * len(frame), [0.0] * len(frame)
            filled = [i for i, text in enumerate(frame["text"]) if text and text.strip()]
            for start in range(0, len(filled), batch):
                part = filled[start:start + batch]
                for i, (label, score) in zip(part, scorer([frame["text"].iloc[j] for j in part])):
                    labels[i], scores[i] = label, round(float(score), 4)
            yield frame.assign(sentiment_label=labels, sentiment_score=scores)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    return messages.mapInPandas(run, f"{schema}, sentiment_label string, sentiment_score double")


def window_messages(
    messages: DataFrame, links: DataFrame, as_of: dt.date, days: int = 30, min_confidence: float = MIN_LINK_CONFIDENCE
) -> DataFrame:
    """Inbound messages of confident links in [as_of - days, as_of]."""
    day = F.to_date("timestamp")
    kept = messages.filter((F.col("direction") == "inbound") & (day >= F.lit(as_of - dt.timedelta(days))) & (day <= F.lit(as_of)))
    return kept.drop("customer_id").join(links.filter(F.col("match_confidence") >= min_confidence).select("msg_id", "customer_id"), "msg_id")


def _has_text() -> Column:
    return F.length(F.coalesce("text", F.lit(""))) > 0


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """Label counts as a map and mean score per customer; one aggregation, labels are few."""
    counts = scored.filter(_has_text()).groupBy("customer_id").agg(
        *[F.count_if(F.col("sentiment_label") == label).alias(label) for label in LABELS], F.avg("sentiment_score").alias("avg_sentiment_score")
    )
    pairs = F.create_map(*[x for label in LABELS for x in (F.lit(label), F.col(label))])
    return counts.select("customer_id", F.map_filter(pairs, lambda _, n: n > 0).alias("sentiment_dist"), "avg_sentiment_score")


def _map_of_top(counts: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """The ``n`` largest counts per customer as a map; ties go to the smaller key."""
    best = top_n(counts, ["customer_id"], [F.desc("n"), F.asc(key)], n)
    return best.groupBy("customer_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "n")))).alias(out))


def topic_distribution(messages: DataFrame, n: int = 5) -> DataFrame:
    """Counts of the ``n`` most frequent topics per customer and the mean similarity of all."""
    assigned = messages.filter(_has_text() & F.col("topic_idx").isNotNull())
    per_topic = assigned.groupBy("customer_id", "topic_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("s"), F.count("similarity").alias("k"))
    mean = per_topic.groupBy("customer_id").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("avg_topic_similarity"))
    return _map_of_top(per_topic, "topic_idx", n, "top_topic_counts").join(mean, "customer_id")


def keyword_counts(messages: DataFrame, min_length: int = 4, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Word counts per customer over whole texts; words combine on the map side before the shuffle."""
    tokens = messages.filter(_has_text()).select("customer_id", F.explode(words(F.col("text"))).alias("word"))
    kept = tokens.filter((F.length("word") >= min_length) & ~F.col("word").isin(*stop_words))
    return kept.groupBy("customer_id", "word").agg(F.count(F.lit(1)).alias("n"))


def top_keywords(messages: DataFrame, n: int = 10, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The ``n`` most frequent words longer than three characters per customer."""
    return _map_of_top(keyword_counts(messages, stop_words=stop_words), "word", n, "top_keywords")


def complaint_types(messages: DataFrame, rules: dict[str, tuple[str, ...]] = COMPLAINT_TYPES) -> DataFrame:
    """Messages per complaint type, types without any left out."""
    lower = F.lower("text")
    counts = messages.filter(_has_text()).groupBy("customer_id").agg(*[F.count_if(any_contains(lower, parts)).alias(name) for name, parts in rules.items()])
    pairs = F.map_filter(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))]), lambda _, n: n > 0)
    return counts.select("customer_id", F.when(F.size(pairs) > 0, pairs).alias("top_complaint_types"))


def last_n_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """References to the newest ``n`` messages, newest first."""
    newest = top_n(messages, ["customer_id"], [F.desc("timestamp"), F.desc("msg_id")], n)
    packed = F.array_sort(F.collect_list(F.struct("rn", "msg_id", "timestamp")))
    return newest.groupBy("customer_id").agg(F.transform(packed, lambda x: F.struct(x["msg_id"].alias("msg_id"), x["timestamp"].alias("timestamp"))).alias("last_n_msg_ids"))


def text_semantics(
    customers: DataFrame, messages: DataFrame, as_of: dt.date, topic_model_version: str = "given", sentiment_model_version: str = "word-list",
    rules: dict[str, tuple[str, ...]] = COMPLAINT_TYPES,
) -> DataFrame:
    """E2, E7, E8, E9 and E10 in one row per customer; NULL where a customer has no messages.

    ``messages`` come from :func:`window_messages` with sentiment and, where known, ``topic_idx``
    and ``similarity`` columns.
    """
    out = customers.select("customer_id").withColumn("as_of_date", F.lit(as_of))
    parts = [sentiment_distribution(messages), top_keywords(messages), complaint_types(messages, rules), last_n_messages(messages)]
    if "topic_idx" in messages.columns:
        parts.append(topic_distribution(messages).withColumn("topic_model_version", F.lit(topic_model_version)))
    for part in parts:
        out = out.join(part, "customer_id", "left")
    return out.withColumn("sentiment_model_version", F.when(F.col("sentiment_dist").isNotNull(), F.lit(sentiment_model_version)))


def dominant(counts: Column) -> Column:
    """The key with the largest count of a map, ties to the smaller key; NULL for an empty map."""
    entries = F.array_sort(
        F.map_entries(counts),
        lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
    )
    return F.when(F.size(counts) > 0, F.element_at(entries, 1)["key"])


def sum_map(rows: DataFrame, column: str, key: str = "key") -> DataFrame:
    """Counts of a map column summed over all rows."""
    return rows.select(F.explode(column).alias(key, "n")).groupBy(key).agg(F.sum("n").alias("count"))


def global_top(rows: DataFrame, column: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` largest sums of a map column."""
    return sum_map(rows, column, key).orderBy(F.desc("count"), F.asc(key)).limit(n)


# ---------------------------------------------------------------------------------------------
# Topics
# ---------------------------------------------------------------------------------------------
def train_topics(vectors: DataFrame, topics: int = 30, min_size: int = 50, seed: int = 42) -> DataFrame:
    """Centroids of a k-means clustering of text vectors; clusters below ``min_size`` become outliers."""
    data = vectors.filter(F.col("embedding").isNotNull()).withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=topics, seed=seed, featuresCol="v", predictionCol="topic_idx", distanceMeasure="cosine", maxIter=20).fit(data)
    sizes = model.transform(data).groupBy("topic_idx").agg(F.count(F.lit(1)).alias("size"))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centres, "topic_idx int, centroid array<double>").join(sizes, "topic_idx").filter(F.col("size") >= min_size)


def assign_topics(vectors: DataFrame, centroids: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """Nearest centroid by cosine and the similarity; -1 below the threshold, NULL without a vector.

    Centroids are one short array per topic; their unit vectors travel to the tasks as one matrix, by which a batch of unit
    vectors is multiplied. Of equally near topics the one with the least number is taken; a vector of zeros or of another
    length than the centroids has no topic.
    """
    found = sorted((r["topic_idx"], r["centroid"]) for r in centroids.select("topic_idx", "centroid").collect())
    found = [(k, c) for k, c in found if np.linalg.norm(c) > 0]
    told = vectors.sparkSession.sparkContext.broadcast((np.array([k for k, _ in found], np.int64), np.array([np.array(c) / np.linalg.norm(c) for _, c in found])))

    @F.arrow_udf("struct<topic:bigint,similarity:double>")
    def nearest(col: pa.Array) -> pa.Array:
        numbers, units = told.value
        size = units.shape[1] if len(numbers) else -1
        fits = pc.fill_null(pc.equal(pc.list_value_length(col), size), False)
        topic, best = np.zeros(len(col), np.int64), np.full(len(col), np.nan)
        if pc.any(fits).as_py():
            x = col.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            long = np.linalg.norm(x, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                near = (x @ units.T) / long[:, None]
            near[~(long > 0)] = np.nan
            at = np.where(np.isnan(near).any(1), 0, near.argmax(1))
            here = fits.to_numpy(zero_copy_only=False)
            topic[here], best[here] = numbers[at], near[np.arange(len(near)), at]
        none = np.isnan(best)
        return pa.StructArray.from_arrays([pa.array(topic, mask=none), pa.array(best, mask=none)], ["topic", "similarity"])

    similarity = F.col("_best")["similarity"]
    topic = F.when(similarity < min_similarity, F.lit(-1)).when(similarity.isNotNull(), F.col("_best")["topic"].cast(centroids.schema["topic_idx"].dataType))
    scored = vectors.withColumn("_best", nearest(F.col("embedding").cast("array<double>")))
    return scored.withColumn("topic_idx", topic).withColumn("similarity", F.round(similarity, 4)).drop("_best")


def topic_keywords(texts: DataFrame, topic: str = "topic_idx", n: int = 10) -> DataFrame:
    """E5: class-based TF-IDF: share of a word in its topic times log(1 + mean topic size / total count).

    Outlier topics (-1) are skipped. ``texts`` holds the topic and the text.
    """
    tokens = texts.filter(F.col(topic).cast("string") != "-1").select(topic, F.explode(bare_words(F.col("text"))).alias("word"))
    counts = tokens.groupBy(topic, "word").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(topic).agg(F.sum("n").alias("topic_words"))
    mean_size = sizes.agg(F.avg("topic_words").alias("a")).scalar()
    totals = counts.groupBy("word").agg(F.sum("n").alias("f"))
    scored = counts.join(F.broadcast(sizes), topic).join(totals, "word").withColumn("score", F.round(F.col("n") / F.col("topic_words") * F.log(1 + mean_size / F.col("f")), 9))  # sizes: a row per topic
    return top_n(scored, [topic], [F.desc("score"), F.asc("word")], n, "rank").select(topic, "rank", "word", "n", "score")


def name_topics(topics: DataFrame, labels: tuple = TOPIC_LABELS) -> DataFrame:
    """The label sharing most keywords (earlier labels win ties), else the first three keywords."""
    lowered = F.array_distinct(F.transform(F.filter("top_keywords", lambda w: w != ""), lambda w: F.lower(w)))
    votes = F.array(*[
        F.struct(F.size(F.array_intersect(lowered, F.array(*[F.lit(w) for w in keys]))).alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label"))
        for i, (label, keys) in enumerate(labels)
    ])
    best = F.array_max(votes)
    plain = F.initcap(F.array_join(F.slice("top_keywords", 1, 3), " / "))
    name = F.when(best["score"] > 0, best["label"]).when(plain != "", plain).otherwise(F.concat(F.lit("Topic "), F.col("topic_idx").cast("string")))
    return topics.withColumn("name", name)


def latest_version(topics: DataFrame) -> Column:
    return topics.agg(F.max_by("model_version", F.struct("created_at", "topic_id")).alias("v")).scalar()


def _for_version(semantics: DataFrame, version: Column) -> DataFrame:
    return semantics.filter(F.col("top_topic_counts").isNotNull() & (F.col("topic_model_version") == version))


def topic_message_counts(topics: DataFrame, semantics: DataFrame, version: str | None = None) -> DataFrame:
    """Topics of one model version (the latest by default) with their message counts, largest first."""
    chosen = latest_version(topics) if version is None else F.lit(version)
    counts = sum_map(_for_version(semantics, chosen), "top_topic_counts", "topic_key")
    mine = topics.filter(F.col("model_version") == chosen).withColumn("topic_key", F.col("topic_idx").cast("string"))
    joined = mine.join(counts, "topic_key", "left").withColumn("message_count", F.coalesce("count", F.lit(0)))
    return joined.drop("topic_key", "count").orderBy(F.desc("message_count"), "topic_idx")


def topic_detail(semantics: DataFrame, topic_key: str | None = None) -> DataFrame:
    """Message count and sentiment totals of the snapshots mentioning a topic, as (topic, label, count) rows."""
    rows = semantics.filter(F.col("top_topic_counts").isNotNull())
    if topic_key is not None:
        rows = rows.filter(F.map_contains_key("top_topic_counts", topic_key))
    per = rows.select(F.explode("top_topic_counts").alias("topic_key", "n"), "sentiment_dist")
    if topic_key is not None:
        per = per.filter(F.col("topic_key") == topic_key)
    messages = per.groupBy("topic_key").agg(F.sum("n").alias("count")).select("topic_key", F.lit("messages").alias("label"), "count")
    moods = per.select("topic_key", F.explode("sentiment_dist").alias("label", "m")).groupBy("topic_key", "label").agg(F.sum("m").alias("count"))
    return messages.unionByName(moods)


def topic_lift(topics: DataFrame, semantics: DataFrame, predictions: DataFrame, version: str | None = None) -> DataFrame:
    """P(high | topic) / P(high) with customer (snapshot) and message counts.

    All predictions count, not only the latest; they are summed per customer before the join, so
    a customer with very many of them adds one row.
    """
    chosen = latest_version(topics) if version is None else F.lit(version)
    mine = topics.filter(F.col("model_version") == chosen).select(F.col("topic_idx").cast("string").alias("topic_key"), "topic_id", "name")
    mentions = _for_version(semantics, chosen).select("customer_id", F.explode("top_topic_counts").alias("topic_key", "n"))
    by_pair = mentions.groupBy("topic_key", "customer_id").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("snapshots"))
    scored = predictions.groupBy("customer_id").agg(F.count(F.lit(1)).alias("preds"), F.count_if(F.col("churn_label") == "high").alias("high"))
    base = predictions.agg(F.coalesce(F.try_divide(F.count_if(F.col("churn_label") == "high").cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("b")).scalar()
    sums = by_pair.join(scored, "customer_id", "left").groupBy("topic_key").agg(
        F.sum("messages").alias("message_count"), F.sum("snapshots").alias("customer_count"), F.sum("preds").alias("preds"), F.sum("high").alias("high")
    )
    rate = F.col("high") / F.col("preds")
    return mine.join(sums, "topic_key").filter(F.col("preds") > 0).select(
        "topic_id", F.col("name").alias("topic_name"), F.round(F.coalesce(F.try_divide(rate, base), F.lit(0.0)), 3).alias("lift"),
        F.round(rate, 3).alias("churn_rate"), F.round(base, 3).alias("baseline_churn_rate"), "message_count", "customer_count",
    )


def nlp_job(messages: DataFrame, links: DataFrame, existing: DataFrame, windowed: DataFrame, as_of: dt.date, min_confidence: float = MIN_LINK_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What one run makes: refreshed signals (C4) of all links, semantics (E11) of every linked customer, counters.

    ``windowed`` are the scored messages of the window. Counters: links trusted enough, those processed, those without a message.
    """
    features = extract_message_features(messages, links, existing, refresh=True, min_confidence=min_confidence)
    semantics = text_semantics(links.select("customer_id").distinct(), windowed, as_of)
    found = messages.select("msg_id", F.lit(True).alias("_found"))
    counters = links.filter(F.col("match_confidence") >= min_confidence).join(found, "msg_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_found").alias("processed"), F.count_if(F.col("_found").isNull()).alias("failed")
    )
    return features, semantics, counters


def nlp_job_summary(semantics: DataFrame) -> DataFrame:
    """Global sentiment, keyword and topic totals of a semantics snapshot in one table."""
    parts = [("sentiment", "sentiment_dist"), ("keyword", "top_keywords"), ("topic", "top_topic_counts")]
    frames = [
        (sum_map(semantics, column) if kind == "sentiment" else global_top(semantics, column, "key")).select(F.lit(kind).alias("kind"), "key", "count")
        for kind, column in parts if column in semantics.columns
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
