"""Per-message signals and vectors (C operators)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.config import MIN_LINK_CONFIDENCE
from ebbtide.functions import text as T
from ebbtide.functions import vectors as V

Encoder = Callable[[list[str]], np.ndarray]


def signal_columns(text_col: str = "text", complaint: tuple[str, ...] = T.COMPLAINT_PATTERNS, refund: tuple[str, ...] = T.REFUND_PATTERNS) -> dict:
    text = F.col(text_col)
    return {**T.message_stats(text), "has_complaint": T.detect_complaint(text, complaint, refund), "has_refund_request": T.detect_refund(text, refund)}


def extract_message_features(
    messages: DataFrame, links: DataFrame, existing: DataFrame, refresh: bool = False, min_confidence: float = MIN_LINK_CONFIDENCE,
    complaint: tuple[str, ...] = T.COMPLAINT_PATTERNS, refund: tuple[str, ...] = T.REFUND_PATTERNS,
) -> DataFrame:
    """C4: signals of confidently linked messages that have none yet, or of all when refreshing."""
    todo = links.filter(F.col("match_confidence") >= min_confidence).select("link_id", "msg_id", "customer_id")
    done = existing.select("link_id", F.lit(True).alias("refreshed"))
    todo = todo.join(done, "link_id", "left") if refresh else todo.join(existing.select("link_id"), "link_id", "left_anti").withColumn("refreshed", F.lit(None).cast("boolean"))
    return todo.join(messages.select("msg_id", "text"), "msg_id").select(
        "link_id", "msg_id", "customer_id", *[c.alias(n) for n, c in signal_columns("text", complaint, refund).items()],
        F.coalesce("refreshed", F.lit(False)).alias("refreshed"),
    )


def extraction_stats(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count(F.lit(1)).alias("processed"), F.count_if("refreshed").alias("refreshed"))


def seconds_between(start: str, end: str):
    """Whole seconds between two zone-free timestamps, whatever the session zone."""
    return F.expr(f"CAST(CAST({end} - {start} AS INTERVAL SECOND) AS BIGINT)")


def response_times(messages: DataFrame, block: str = "hour") -> DataFrame:
    """Seconds from each inbound message to the customer's next outbound one, NULL when none follows.

    Order is (timestamp, msg_id). The search runs inside (customer, hour) blocks; what it does not
    find there is the first reply of a later block, looked up on one row per block. A customer with
    a third of all messages is thereby spread over its hours.
    """
    rows = messages.withColumn("_block", F.date_trunc(block, "timestamp").cast("timestamp_ntz"))
    reply = F.when(F.col("direction") == "outbound", F.col("timestamp"))
    ahead = Window.partitionBy("customer_id", "_block").orderBy("timestamp", "msg_id").rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy("customer_id").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    blocks = rows.groupBy("customer_id", "_block").agg(F.min(reply).alias("_first")).select(
        "customer_id", "_block", F.first("_first", ignorenulls=True).over(later).alias("_later")
    )
    found = rows.withColumn("_near", F.first(reply, ignorenulls=True).over(ahead)).filter("direction = 'inbound'")
    joined = found.join(blocks, ["customer_id", "_block"]).withColumn("replied_at", F.coalesce("_near", "_later"))
    return joined.select("msg_id", "customer_id", "timestamp", "replied_at", seconds_between("timestamp", "replied_at").alias("response_time_secs"))


def hashing_encoder(dim: int = 64) -> Encoder:
    """A stand-in encoder: token hashes summed into ``dim`` signed slots, unit length."""
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            codes = pd.util.hash_array(np.array(text.lower().split(), dtype=object))
            np.add.at(out[i], (codes % dim).astype(int), np.where((codes >> np.uint64(32)) & np.uint64(1), 1.0, -1.0))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return encode


def embed_messages(messages: DataFrame, encoder: Callable[[], Encoder] = hashing_encoder, batch: int = 32, version: str = "hashing-64") -> DataFrame:
    """Vectors for texts, NULL for blank ones. ``encoder`` makes the encoder; each task calls it once, so a model is never pickled."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for frame in frames:
            texts = frame["text"].fillna("")
            vectors: list = [None] * len(frame)
            filled = np.flatnonzero(texts.str.strip().str.len().to_numpy() > 0)
            for start in range(0, len(filled), batch):
                part = filled[start:start + batch]
                for at, vector in zip(part, encode([texts.iloc[i] for i in part])):
                    vectors[at] = vector.tolist()
            yield pd.DataFrame({"msg_id": frame["msg_id"], "embedding": vectors, "embedding_model_version": version})

    key = messages.schema["msg_id"].dataType.simpleString()
    return messages.select("msg_id", "text").mapInPandas(run, f"msg_id {key}, embedding array<float>, embedding_model_version string")


def mean_embedding(vectors: DataFrame, key: str = "customer_id", order: str | None = None) -> DataFrame:
    """Element-wise mean per key, count and (with ``order``) the last vector; missing and all-zero vectors do not count."""
    usable = vectors.filter(F.col("embedding").isNotNull() & ~V.is_zero(F.col("embedding")))
    aggs = [Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("_m"), F.count(F.lit(1)).alias("embedding_count")]
    if order is not None:
        aggs.append(F.max_by("embedding", order).alias("last_embedding"))
    means = usable.groupBy(key).agg(*aggs).withColumn("avg_embedding", vector_to_array("_m")).drop("_m")
    return vectors.select(key).distinct().join(means, key, "left").withColumn("embedding_count", F.coalesce("embedding_count", F.lit(0)))


def mean_embedding_versioned(vectors: DataFrame, key: str = "customer_id", version: str = "embedding_model_version") -> tuple[DataFrame, DataFrame]:
    """Means of keys with one vector version, and the keys that mix versions."""
    usable = vectors.filter(F.col("embedding").isNotNull() & ~V.is_zero(F.col("embedding")))
    spans = usable.groupBy(key).agg(F.min(version).alias("lo"), F.max(version).alias("hi"), F.count(F.lit(1)).alias("vectors"))
    mixed = spans.filter("lo <> hi").select(key, "vectors", F.col("lo").alias("version_low"), F.col("hi").alias("version_high"))
    single = vectors.join(mixed.select(key), key, "left_anti")
    return mean_embedding(single, key), mixed
