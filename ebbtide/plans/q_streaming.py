"""The streaming jobs run over stored messages until they are used up (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.plans.bindings import Tables
from ebbtide.plans.q_ingest import COMMON_COMPLAINT, COMMON_REFUND, _sql_rule
from ebbtide.plans.registry import query
from ebbtide.sources.imports import scratch_dir
from ebbtide.streaming import jobs


def as_stream(t: Tables, rows: DataFrame, label: str) -> DataFrame:
    """Store rows as files and read the folder as a stream."""
    folder = scratch_dir(t.spark, label)
    rows.write.mode("overwrite").parquet(folder)
    return t.spark.readStream.schema(rows.schema).parquet(folder)


def finish(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    return jobs.run_available(stream, scratch_dir(t.spark, f"{label}-out"), scratch_dir(t.spark, f"{label}-ck"))


def talk(t: Tables) -> DataFrame:
    return t.messages().select("msg_id", F.col("phone_number").cast("bigint").alias("customer_id"), "direction", "timestamp")


@query("stream_ingest_messages", "SELECT phone AS phone_number, timestamp, sha256(text) AS text_hash FROM texts GROUP BY 1, 2, 3", "texts")
def _(t):
    chats = t.texts().select(F.col("phone").alias("phone_number"), "timestamp", "text")
    out = finish(t, jobs.stream_ingest_messages(as_stream(t, chats.unionByName(chats), "chat")), "ingest")
    return out.select("phone_number", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.sha2("text", 256).alias("text_hash"))


@query("stream_message_features", f"""
    SELECT msg_id * 10 AS link_id, msg_id, customer_id, length(text) AS msg_length, length(text) - length(replace(text, '!', '')) AS num_exclamations, length(text) - length(replace(text, '?', '')) AS num_questions,
           {_sql_rule(COMMON_COMPLAINT + COMMON_REFUND)} AS has_complaint, {_sql_rule(COMMON_REFUND)} AS has_refund_request FROM texts WHERE customer_id % 4 <> 0""", "texts")
def _(t):
    links = t.texts().select("msg_id", (F.col("msg_id") * 10).alias("link_id"), "customer_id", F.when(F.col("customer_id") % 4 == 0, 0.6).otherwise(1.0).alias("match_confidence"))
    stream = as_stream(t, t.texts().select("msg_id", "text"), "chat")
    folder, checkpoint = scratch_dir(t.spark, "features-out"), scratch_dir(t.spark, "features-ck")
    sink = jobs.link_and_append(folder, lambda: links, complaint=COMMON_COMPLAINT, refund=COMMON_REFUND)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows").drop("batch")


@query("stream_message_counts", """
    SELECT customer_id, CAST(timestamp AS DATE) AS day, count(*) AS messages FROM (SELECT CAST(phone_number AS BIGINT) AS customer_id, timestamp FROM messages)
    WHERE CAST(timestamp AS DATE) + 1 <= (SELECT max(timestamp) - INTERVAL 1 DAY FROM messages) GROUP BY 1, 2""", "messages")
def _(t):
    return finish(t, jobs.stream_message_counts(as_stream(t, talk(t), "talk")), "counts")


@query("stream_response_times", """
    SELECT a.customer_id, a.msg_id, CAST(floor((epoch_us(min(b.timestamp)) - epoch_us(a.timestamp)) / 1000000) AS BIGINT) AS response_time_secs
    FROM (SELECT *, CAST(phone_number AS BIGINT) AS customer_id FROM messages) a JOIN (SELECT *, CAST(phone_number AS BIGINT) AS customer_id FROM messages WHERE direction = 'outbound') b
      ON b.customer_id = a.customer_id AND (b.timestamp > a.timestamp OR (b.timestamp = a.timestamp AND b.msg_id > a.msg_id)) WHERE a.direction = 'inbound' GROUP BY a.customer_id, a.msg_id, a.timestamp""", "messages")
def _(t):
    # a message of nobody far ahead ends the stream: it moves the watermark past all hours
    end = talk(t).agg(F.max("timestamp").alias("timestamp")).selectExpr("-1L AS msg_id", "-1L AS customer_id", "'inbound' AS direction", "timestamp + INTERVAL 3 DAYS AS timestamp")
    return finish(t, jobs.stream_response_times(as_stream(t, talk(t).unionByName(end), "talk")), "replies")
