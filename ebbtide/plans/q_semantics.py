"""Queries over sentiment, topic and keyword operators (E)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ebbtide.operators import messages as C
from ebbtide.operators import semantics as E
from ebbtide.operators import stored as ST
from ebbtide.plans.bindings import Tables, add_cte, r6
from ebbtide.plans.registry import query
from ebbtide.sources.imports import scratch_dir

# Frequent words of the given texts stand in for the mood words and label keywords.
GOOD, BAD = ("the", "la", "die", "and"), ("of", "de", "der", "was")
LABELS_FOR_DATA = (("English prose", ("the", "with", "that", "was")), ("Prose romane", ("les", "des", "que", "une")), ("Deutsche Prosa", ("und", "der", "die", "mit")))
RULES = {"refund": ("tion",), "delivery": ("ther", "eau"), "product": ("ung", "ado"), "service": ("quick brown",)}


def chat_window(t: Tables):
    """Scored inbound chat messages of the 30 days up to the newest message, with given topics."""
    links = t.chats().select("msg_id", "customer_id", F.when(F.col("customer_id") % 9 == 0, 0.6).otherwise(1.0).alias("match_confidence"))
    scored = E.score_sentiment(E.window_messages(t.chats(), links, t.anchor("chats")), GOOD, BAD)
    return scored.withColumn("topic_idx", F.length("text") % 6).withColumn("similarity", F.round(1.0 / (1 + F.length("text") % 10), 4))


_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


def _hits(column: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter({_TOKENS.format(column)}, lambda w: list_contains({list(words)}, w)))"


add_cte("scored_docs", "", f"""
    SELECT *, round(CASE WHEN g + b = 0 THEN 0.0 ELSE CAST(g - b AS DOUBLE) / (g + b) END, 4) AS score
    FROM (SELECT doc_id, lang, source, {_hits('text', GOOD)} AS g, {_hits('text', BAD)} AS b FROM documents)""")
add_cte("win", "chats anchor_chats", f"""
    SELECT *, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS label FROM (
        SELECT *, round(CASE WHEN g + b = 0 THEN 0.0 ELSE CAST(g - b AS DOUBLE) / (g + b) END, 4) AS score FROM (
            SELECT c.*, {_hits('text', GOOD)} AS g, {_hits('text', BAD)} AS b, length(text) % 6 AS topic_idx, round(1.0::DOUBLE / (1 + length(text) % 10), 4) AS similarity
            FROM chats c, anchor_chats a WHERE direction = 'inbound' AND customer_id % 9 <> 0 AND CAST(timestamp AS DATE) BETWEEN a.as_of - 30 AND a.as_of))""")
add_cte("win_words", "win", r"""
    SELECT customer_id, word, count(*) AS n FROM (SELECT customer_id, unnest(string_split_regex(lower(text), '[\s\p{Z}\x0B\x1C-\x1F\x85]+')) AS word FROM win)
    WHERE length(word) > 3 AND word NOT IN ('yang', 'di', 'dan', 'ke', 'dari', 'ini', 'itu', 'untuk', 'dengan', 'adalah', 'saya', 'aku', 'kamu', 'dia') GROUP BY 1, 2""")
_TOP_WORDS = "SELECT customer_id, word AS key, n AS count FROM win_words QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, word) <= 10"
_TOP_TOPICS = "SELECT customer_id, CAST(topic_idx AS VARCHAR) AS key, n AS count FROM (SELECT customer_id, topic_idx, count(*) AS n FROM win GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, topic_idx) <= 5"
_SENTIMENT = "SELECT customer_id, label AS key, count(*) AS count FROM win GROUP BY 1, 2"
_COMPLAINTS = " UNION ALL ".join(
    f"SELECT customer_id, '{n}' AS key, count(*) AS count FROM win WHERE {' OR '.join(f'contains(lower(text), {p!r})' for p in parts)} GROUP BY 1" for n, parts in RULES.items())


def _map_rows(df, column):
    return df.select("customer_id", F.explode(column).alias("key", "count"))


@query("score_sentiment", "SELECT doc_id, score + 0.0 AS sentiment_score, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM scored_docs", "scored_docs")
def _(t):
    return E.score_sentiment(t.read("documents"), GOOD, BAD).select("doc_id", (F.col("sentiment_score") + 0.0).alias("sentiment_score"), "sentiment_label")


@query("score_sentiment_injected", "SELECT msg_id, CASE WHEN length(text) % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment_label, CASE WHEN length(text) % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE AS sentiment_score FROM texts", "texts")
def _(t):
    def by_length(texts):
        return [("positive", 0.5) if len(x) % 2 == 0 else ("negative", -0.5) for x in texts]

    return E.score_sentiment_with(t.texts().select("msg_id", "text"), lambda: by_length).drop("text")


@query("sentiment_distribution", f"SELECT s.*, round(a.m, 6) + 0.0 AS avg_sentiment_score FROM ({_SENTIMENT}) s JOIN (SELECT customer_id, avg(score) AS m FROM win GROUP BY 1) a USING (customer_id)", "win")
def _(t):
    out = E.sentiment_distribution(chat_window(t))
    return out.select("customer_id", r6("avg_sentiment_score").alias("avg_sentiment_score"), F.explode("sentiment_dist").alias("key", "count"))


@query("train_topics")
def _(t):
    return E.train_topics(t.read("embeddings"), min_size=5)


@query("topic_distribution", f"SELECT x.*, round(a.m, 6) AS avg_topic_similarity FROM ({_TOP_TOPICS}) x JOIN (SELECT customer_id, avg(similarity) AS m FROM win GROUP BY 1) a USING (customer_id)", "win")
def _(t):
    return E.topic_distribution(chat_window(t)).select("customer_id", r6("avg_topic_similarity").alias("avg_topic_similarity"), F.explode("top_topic_counts").alias("key", "count"))


@query("top_keywords", _TOP_WORDS, "win_words")
def _(t):
    return _map_rows(E.top_keywords(chat_window(t)), "top_keywords")


@query("complaint_types", _COMPLAINTS, "win")
def _(t):
    return _map_rows(E.complaint_types(chat_window(t), RULES), "top_complaint_types")


@query("last_n_messages", "SELECT customer_id, rn - 1 AS pos, msg_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY timestamp DESC, msg_id DESC) AS rn FROM win) WHERE rn <= 10", "win")
def _(t):
    return E.last_n_messages(chat_window(t)).select("customer_id", F.posexplode("last_n_msg_ids").alias("pos", "m")).select("customer_id", "pos", "m.msg_id", "m.timestamp")


def semantics_snapshot(t: Tables):
    return E.text_semantics(t.chats().select("customer_id").distinct(), chat_window(t), t.anchor("chats"), rules=RULES)


@query("text_semantics", f"""
    SELECT c.customer_id, a.as_of AS as_of_date, s.k AS sentiment, round(s.m, 6) + 0.0 AS avg_sentiment_score, k.k AS keywords, tp.k AS topics, round(ts.m, 6) AS avg_topic_similarity,
           cp.k AS complaints, w.n AS messages
    FROM (SELECT DISTINCT customer_id FROM chats) c CROSS JOIN anchor_chats a
    LEFT JOIN (SELECT customer_id, string_agg(key || '=' || count, ',' ORDER BY key) AS k, any_value(m) AS m FROM ({_SENTIMENT}) JOIN (SELECT customer_id, avg(score) AS m FROM win GROUP BY 1) USING (customer_id) GROUP BY 1) s USING (customer_id)
    LEFT JOIN (SELECT customer_id, string_agg(key || '=' || count, ',' ORDER BY key) AS k FROM ({_TOP_WORDS}) GROUP BY 1) k USING (customer_id)
    LEFT JOIN (SELECT customer_id, string_agg(key || '=' || count, ',' ORDER BY key) AS k FROM ({_TOP_TOPICS}) GROUP BY 1) tp USING (customer_id)
    LEFT JOIN (SELECT customer_id, avg(similarity) AS m FROM win GROUP BY 1) ts USING (customer_id)
    LEFT JOIN (SELECT customer_id, string_agg(key || '=' || count, ',' ORDER BY key) AS k FROM ({_COMPLAINTS}) GROUP BY 1) cp USING (customer_id)
    LEFT JOIN (SELECT customer_id, least(10, count(*)) AS n FROM win GROUP BY 1) w USING (customer_id)""", "chats win_words")
def _(t):
    def flat(column):
        return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    s = semantics_snapshot(t)
    return s.select("customer_id", "as_of_date", flat("sentiment_dist").alias("sentiment"), r6("avg_sentiment_score").alias("avg_sentiment_score"), flat("top_keywords").alias("keywords"),
                    flat("top_topic_counts").alias("topics"), r6("avg_topic_similarity").alias("avg_topic_similarity"), flat("top_complaint_types").alias("complaints"),
                    F.size("last_n_msg_ids").alias("messages"))


# One semantics row per customer and week, with maps of event kinds in the parts of topics and moods.
def weekly_semantics(t: Tables):
    kinds = {"0": "click", "1": "error", "2": "purchase", "3": "signup", "4": "view"}
    mood = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")

    def as_map(names):
        return F.map_filter(F.create_map(*[x for k in names for x in (F.lit(k), F.col(f"c_{k}"))]), lambda _, n: n > 0)

    e = t.read("events").withColumn("mood", mood)
    counts = e.groupBy(F.col("user_id").alias("customer_id"), F.to_date(F.date_trunc("week", "ts")).alias("as_of_date")).agg(
        *[F.count_if(F.col("event_type") == v).alias(f"c_{k}") for k, v in kinds.items()], *[F.count_if(F.col("mood") == m).alias(f"c_{m}") for m in E.LABELS])
    version = F.when(F.dayofmonth("as_of_date") % 2 == 0, "m0").otherwise("m1")
    return counts.select("customer_id", "as_of_date", as_map(kinds).alias("top_topic_counts"), as_map(E.LABELS).alias("sentiment_dist"), version.alias("topic_model_version"))


def topic_table(t: Tables):
    n = t.read("nation")
    return n.select(F.col("n_nationkey").alias("topic_id"), (F.col("n_nationkey") % 13).alias("topic_idx"), F.col("n_name").alias("name"),
                    F.concat(F.lit("m"), F.floor(F.col("n_nationkey") / 13).cast("string")).alias("model_version"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")).alias("created_at"))


add_cte("wk", "", """
    SELECT user_id AS customer_id, CAST(date_trunc('week', ts) AS DATE) AS as_of_date, CASE WHEN day(CAST(date_trunc('week', ts) AS DATE)) % 2 = 0 THEN 'm0' ELSE 'm1' END AS version,
           CASE event_type WHEN 'click' THEN '0' WHEN 'error' THEN '1' WHEN 'purchase' THEN '2' WHEN 'signup' THEN '3' ELSE '4' END AS topic_key,
           CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS mood FROM events""")
add_cte("topics", "", "SELECT n_nationkey AS topic_id, n_nationkey % 13 AS topic_idx, n_name AS name, 'm' || (n_nationkey // 13) AS version FROM nation")


@query("dominant_topic", """
    SELECT customer_id, as_of_date, t.topic_key AS dominant_topic, m.mood AS dominant_sentiment
    FROM (SELECT customer_id, as_of_date, topic_key FROM (SELECT customer_id, as_of_date, topic_key, count(*) AS n FROM wk GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY customer_id, as_of_date ORDER BY n DESC, topic_key) = 1) t
    JOIN (SELECT customer_id, as_of_date, mood FROM (SELECT customer_id, as_of_date, mood, count(*) AS n FROM wk GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY customer_id, as_of_date ORDER BY n DESC, mood) = 1) m USING (customer_id, as_of_date)""", "wk")
def _(t):
    return weekly_semantics(t).select("customer_id", "as_of_date", E.dominant(F.col("top_topic_counts")).alias("dominant_topic"), E.dominant(F.col("sentiment_dist")).alias("dominant_sentiment"))


@query("global_sentiment", "SELECT mood AS label, count(*) AS count FROM wk GROUP BY 1", "wk")
def _(t):
    return E.sum_map(weekly_semantics(t), "sentiment_dist", "label")


@query("global_topics", "SELECT topic_key AS topic, count(*) AS count FROM wk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "wk")
def _(t):
    return E.global_top(weekly_semantics(t), "top_topic_counts", "topic")


@query("global_keywords", f"SELECT key AS keyword, sum(count) AS count FROM ({_TOP_WORDS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "win_words")
def _(t):
    return E.global_top(E.top_keywords(chat_window(t)), "top_keywords", "keyword")


@query("topic_message_counts", "SELECT topic_id, topic_idx, name, coalesce(n, 0) AS message_count FROM topics t LEFT JOIN (SELECT topic_key, count(*) AS n FROM wk WHERE version = 'm1' GROUP BY 1) c ON c.topic_key = CAST(t.topic_idx AS VARCHAR) WHERE t.version = 'm1'", "wk topics")
def _(t):
    return E.topic_message_counts(topic_table(t), weekly_semantics(t)).select("topic_id", "topic_idx", "name", "message_count")


@query("topic_detail", """
    SELECT topic_key, 'messages' AS label, count(*) AS count FROM wk GROUP BY 1
    UNION ALL SELECT k.topic_key, m.mood, sum(m.n) FROM (SELECT DISTINCT customer_id, as_of_date, topic_key FROM wk) k
    JOIN (SELECT customer_id, as_of_date, mood, count(*) AS n FROM wk GROUP BY 1, 2, 3) m USING (customer_id, as_of_date) GROUP BY 1, 2""", "wk")
def _(t):
    return E.topic_detail(weekly_semantics(t))


@query("topic_lift", """
    WITH m AS (SELECT topic_key, customer_id, count(*) AS n, count(DISTINCT as_of_date) AS snaps FROM wk WHERE version = 'm1' GROUP BY 1, 2),
    p AS (SELECT customer_id, count(*) AS preds, count(*) FILTER (churn_label = 'high') AS high FROM predictions GROUP BY 1),
    b AS (SELECT count(*) FILTER (churn_label = 'high') / count(*) AS base FROM predictions),
    s AS (SELECT topic_key, sum(n) AS message_count, sum(snaps) AS customer_count, sum(high) / sum(preds) AS rate FROM m JOIN p USING (customer_id) GROUP BY 1)
    SELECT t.topic_id, t.name AS topic_name, round(rate / base, 3) AS lift, round(rate, 3) AS churn_rate, round(base, 3) AS baseline_churn_rate, message_count, customer_count
    FROM s JOIN topics t ON CAST(t.topic_idx AS VARCHAR) = s.topic_key AND t.version = 'm1', b""", "wk topics predictions")
def _(t):
    return E.topic_lift(topic_table(t), weekly_semantics(t), t.predictions())


# ---------------------------------------------------------------------------------------------
# Topics of texts and vectors
# ---------------------------------------------------------------------------------------------
@query("assign_topics", """
    WITH c AS (SELECT label AS topic_idx, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT vec_id, topic_idx, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS sim FROM embeddings, c)
    SELECT vec_id, CASE WHEN sim < 0.4 THEN -1 ELSE topic_idx END AS topic_idx, round(sim, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic_idx) = 1""")
def _(t):
    e = t.read("embeddings")
    centroids = C.mean_embedding(e, "label").select(F.col("label").alias("topic_idx"), F.col("avg_embedding").alias("centroid"))
    return E.assign_topics(e, centroids, 0.4).select("vec_id", "topic_idx", "similarity")


add_cte("doc_words", "", f"SELECT lang AS topic, word, count(*) AS n FROM (SELECT lang, unnest({_TOKENS.format('text')}) AS word FROM documents) GROUP BY 1, 2")
_KEYWORDS = """
    SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS rank, word, n, score FROM (
        SELECT topic, word, n, round(n / size * ln(1 + avg_size / f), 9) AS score FROM doc_words JOIN (SELECT topic, sum(n) AS size FROM doc_words GROUP BY 1) USING (topic)
        JOIN (SELECT word, sum(n) AS f FROM doc_words GROUP BY 1) USING (word), (SELECT avg(s) AS avg_size FROM (SELECT sum(n) AS s FROM doc_words GROUP BY topic)))
    QUALIFY rank <= 10"""


def _doc_keywords(t):
    return E.topic_keywords(t.read("documents").select(F.col("lang").alias("topic"), "text"), "topic")


@query("topic_keywords", _KEYWORDS, "doc_words")
def _(t):
    return _doc_keywords(t)


def _votes() -> str:
    parts = [f"{{'score': len(list_filter({list(keys)}, lambda w: list_contains(kw, w))), 'ord': {-i}, 'label': '{label}'}}" for i, (label, keys) in enumerate(LABELS_FOR_DATA)]
    return f"list_max([{', '.join(parts)}])"


@query("name_topics", f"""
    WITH k AS (SELECT topic, list(word ORDER BY rank) AS kw FROM ({_KEYWORDS}) GROUP BY 1)
    SELECT topic, CASE WHEN (v).score > 0 THEN (v).label ELSE array_to_string(list_transform(kw[1:3], lambda w: upper(w[1]) || w[2:]), ' / ') END AS name FROM (SELECT topic, kw, {_votes()} AS v FROM k)""", "doc_words")
def _(t):
    packed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    topics = _doc_keywords(t).groupBy("topic").agg(packed.alias("top_keywords")).withColumn("topic_idx", F.lit(0))
    return E.name_topics(topics, LABELS_FOR_DATA).select("topic", "name")


@query("store_topics", """
    WITH k AS (SELECT n_nationkey % 13 AS topic_idx, 'm' || (n_nationkey // 13) AS version, lower(n_name) AS word, n_nationkey AS n FROM nation)
    SELECT topic_idx, version AS model_version, word AS keyword, upper(word[1]) || word[2:] AS name, TIMESTAMP '2024-02-01' + to_days(CASE WHEN version = 'm0' AND topic_idx % 2 = 0 THEN 0 ELSE 1 END) AS created_at,
           TIMESTAMP '2024-02-02' AS updated_at FROM k WHERE NOT contains(word, ' ')""")
def _(t):
    """Topic names of two model versions; half of the first version was stored the day before under other names."""
    n, folder = t.read("nation").filter("NOT contains(n_name, ' ')"), scratch_dir(t.spark, "topics")
    rows = n.select((F.col("n_nationkey") % 13).alias("topic_idx"), F.floor(F.col("n_nationkey") / 13).alias("v"), F.array(F.lower("n_name"), F.lit(" ")).alias("top_keywords"))
    first = rows.filter("v = 0 AND topic_idx % 2 = 0").withColumn("top_keywords", F.array(F.lit("old")))
    ST.store_topics(first, folder, "m0", dt.datetime(2024, 2, 1))
    parts = [ST.store_topics(rows.filter(F.col("v") == v), folder, f"m{v}", dt.datetime(2024, 2, 2)) for v in (0, 1)]
    out = parts[0].unionByName(parts[1])
    return out.select("topic_idx", "model_version", F.col("top_keywords")[0].alias("keyword"), "name", "created_at", "updated_at")


@query("nlp_job_counters", """
    SELECT count(*) AS total, count(*) FILTER (customer_id % 7 <> 0) AS processed, count(*) FILTER (customer_id % 7 = 0) AS failed FROM chats WHERE customer_id % 9 <> 0""", "chats")
def _(t):
    """Messages of every seventh conversation are missing from the store."""
    links = t.chats().select("msg_id", (F.col("msg_id") * 10).alias("link_id"), "customer_id", F.when(F.col("customer_id") % 9 == 0, 0.6).otherwise(1.0).alias("match_confidence"))
    none = t.spark.createDataFrame([], "link_id long")
    return E.nlp_job(t.chats().filter("customer_id % 7 <> 0"), links, none, chat_window(t), t.anchor("chats"))[2]


@query("nlp_job", f"""
    SELECT 'sentiment' AS kind, key, sum(count) AS count FROM ({_SENTIMENT}) GROUP BY 2
    UNION ALL (SELECT 'keyword', key, sum(count) AS c FROM ({_TOP_WORDS}) GROUP BY 2 ORDER BY c DESC, key LIMIT 10)
    UNION ALL (SELECT 'topic', key, sum(count) AS c FROM ({_TOP_TOPICS}) GROUP BY 2 ORDER BY c DESC, key LIMIT 10)""", "win_words")
def _(t):
    return E.nlp_job_summary(semantics_snapshot(t))
