"""Registered queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ebbtide.llm import alignment, bpe, chat, decontaminate, language, licences, mixing, negatives, pages, simhash, suffixes, tokens, vectors
from ebbtide.llm.common import row_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op2_decontaminate",
    f"""
    WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT item_id, len(p) AS length, array_to_string(p, ' ') AS win
        FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i : i + 9])) AS p FROM items WHERE len(w) > 0)
    ),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    lengths AS (SELECT DISTINCT length FROM windows),
    places AS (
        SELECT r, length, i, array_to_string(w[i : i + length - 1], ' ') AS win
        FROM (SELECT r, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM docs, lengths)
    ),
    found AS (SELECT r, i, p.length, item_id FROM places p JOIN windows USING (win)),
    hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + length)) AS k FROM found) GROUP BY r),
    listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
    """,
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query(
    "op4_mix",
    r"""
    WITH docs AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
        FROM documents
    ),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
        FROM docs GROUP BY source
    ),
    levels AS (
        SELECT *, 3.0::DOUBLE * source_size AS cap,
            (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM sources
    ),
    goals AS (
        SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, cap / w) FROM levels WHERE cap > w * level)), cap) AS target FROM levels
    ),
    runs AS (
        SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
            coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
    )
    SELECT doc_id, size, source_size, target,
        CAST(size * (whole + CASE WHEN before + size <= rest OR (before < rest AND 2 * (rest - before) >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS rest FROM runs)
    """,
)
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_ids")
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stored_tokens(table(spark, sf_dir, "documents"))


@query("op6_chat_format")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is the event that sets its message; conversation -1 says the control strings themselves."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    events = row_id(rows, "message").withColumns({"seq": F.lit(0).cast("long"), "kind": F.lit("message")})
    return chat.digests(chat.render(chat.messages(events)))


@query("op7_licences")
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("_rid")


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


@query(
    "op11_hard_negatives",
    """
    WITH vectors AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scores AS (
        SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
            CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
        FROM vectors a JOIN vectors b ON a.r <> b.r AND len(a.q) = len(b.q)
        WHERE a.vec_id % 100 = 0
    ),
    positives AS (
        SELECT ar, anchor_id, id AS positive_id, score AS positive_score
        FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS place FROM scores WHERE same) WHERE place <= 5
    ),
    windows AS (
        SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
            row_number() OVER (PARTITION BY p.ar, positive_id ORDER BY score DESC, id) AS place
        FROM positives p JOIN scores s ON p.ar = s.ar AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    )
    SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM windows WHERE place <= 10
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents")).drop("_rid")
