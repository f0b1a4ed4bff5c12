"""Incremental jobs over message streams (S1-S4), each equal to its batch operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ebbtide.functions import text as T
from ebbtide.operators.messages import signal_columns
from ebbtide.sources.imports import stored


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it to parquet with a checkpoint, and read the result back."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def with_event_time(messages: DataFrame, delay: str, column: str = "timestamp") -> DataFrame:
    """Zone-free times become instants (the session zone is UTC), as watermarks need."""
    return messages.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def stream_ingest_messages(messages: DataFrame, delay: str = "1 day", retried: tuple[str, ...] | None = None) -> DataFrame:
    """Each (phone, time, text) once. State is dropped behind the watermark; later repeats arrive as late rows.

    A sender that tries again may stamp the message anew. ``retried`` names what stays the same then, such as the message id: of
    rows that agree in it and come within ``delay`` of each other the first is kept, whatever their times.
    """
    timed = with_event_time(messages, delay)
    return timed.dropDuplicatesWithinWatermark(list(retried)) if retried else timed.dropDuplicates(["phone_number", "timestamp", "text"])


def stream_message_features(
    messages: DataFrame, links: DataFrame, min_confidence: float = 0.7, complaint: tuple[str, ...] = T.COMPLAINT_PATTERNS, refund: tuple[str, ...] = T.REFUND_PATTERNS
) -> DataFrame:
    """Signals of arriving messages, joined to the stored links."""
    known = links.filter(F.col("match_confidence") >= min_confidence).select("link_id", "msg_id", "customer_id")
    return messages.select("msg_id", "text").join(known, "msg_id").select(
        "link_id", "msg_id", "customer_id", *[c.alias(n) for n, c in signal_columns("text", complaint, refund).items()]
    )


def link_and_append(
    path: str, links: Callable[[], DataFrame], min_confidence: float = 0.7, complaint: tuple[str, ...] = T.COMPLAINT_PATTERNS, refund: tuple[str, ...] = T.REFUND_PATTERNS
) -> Callable[[DataFrame, int], None]:
    """S2 sink for ``foreachBatch``: messages whose link is not there yet wait and are tried again with every batch.

    Batch ``n`` writes ``path/rows/batch=n`` and the messages still waiting to ``path/waiting/n``, and reads ``path/waiting/n-1``.
    So a replayed batch replaces what it wrote before, and no batch reads the rows of earlier ones. ``links`` is
    called for every batch and gives the links known by then. Repeated messages are S1's to remove.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("msg_id", "text")
        before = stored(batch.sparkSession, f"{path}/waiting/{batch_id - 1}")
        if before is not None:
            rows = rows.unionByName(before)
        known = links()
        linked = stream_message_features(rows, known, min_confidence, complaint, refund).dropDuplicates(["link_id"])
        linked.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        ready = known.filter(F.col("match_confidence") >= min_confidence).select("msg_id")
        rows.join(ready, "msg_id", "left_anti").write.mode("overwrite").parquet(f"{path}/waiting/{batch_id}")

    return write


def stream_message_counts(messages: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """S3: messages per customer and day, given out once the watermark has passed the day."""
    counts = with_event_time(messages, delay).groupBy("customer_id", F.window("timestamp", window).alias("w")).agg(F.count(F.lit(1)).alias("messages"))
    return counts.select("customer_id", F.to_date("w.start").alias("day"), "messages")


class LateRows(StreamingQueryListener):
    """Stores how many rows each trigger left out because they were behind the watermark, a row per trigger and stateful operator.

    An aggregation combines rows of a task before it looks at the watermark, so for S3 the number is that of
    late (customer, day) groups per task; behind S1, whose operator sees every message, it is that of messages.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        rows = [(str(told.runId), told.batchId, place, op.operatorName, op.numRowsDroppedByWatermark) for place, op in enumerate(told.stateOperators) if op.numRowsDroppedByWatermark]
        if rows:
            self.spark.createDataFrame(rows, LATE).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


LATE = "run_id string, batch_id long, place int, operator string, late_rows long"


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """What :class:`LateRows` stored; a trigger that ran again after a failure counts once."""
    found = stored(spark, path)
    return (found if found is not None else spark.createDataFrame([], LATE)).dropDuplicates(["run_id", "batch_id", "place"])


#: Groups of customers that share a state, and parts into which the waiting messages of a group are dealt.
GROUPS, PARTS = 16, 16
HOUR_MS, DAY_US = 3_600_000, 86_400_000_000
_WHO = ["nobody", "customer"]


class _Hour(StatefulProcessor):
    """Messages of a group of customers and an hour, kept until the watermark has passed the hour; then whatever order they came in is gone.

    Gives out replies found inside the hour, messages still waiting, and each customer's first outbound message of the hour for
    the waiting ones of earlier hours, once for every part.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "nobody boolean, customer long, at long, msg_id long, outbound boolean")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        if not self.said.exists():
            self.handle.registerTimer(int(key[1].timestamp() * 1000) + HOUR_MS)
        outbound = (frame["direction"] == "outbound").tolist()
        self.said.appendList(list(zip(*[frame[c].tolist() for c in (*_WHO, "at", "msg_id")], outbound, strict=True)))
        yield _told(np.zeros((0, 4), np.int64), [], [], key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        said = np.array([tuple(r) for r in self.said.get()], np.int64).reshape(-1, 5)
        said = said[np.lexsort((said[:, 3], said[:, 2], said[:, 1], said[:, 0]))]
        self.said.clear()
        who, out = np.cumsum(np.any(np.diff(said[:, :2], axis=0, prepend=said[:1, :2]), axis=1)), np.flatnonzero(said[:, 4])
        after = np.append(out, -1)[np.searchsorted(out, np.arange(len(said)))]  # the first outbound message at or after each
        answered = (after >= 0) & (who[after] == who)
        near, open_ = (np.flatnonzero((said[:, 4] == 0) & x) for x in (answered, ~answered))
        first = out[np.unique(who[out], return_index=True)[1]]
        parts = [said[near, 3] % PARTS, said[open_, 3] % PARTS, np.tile(np.arange(PARTS), len(first))]
        rows = np.concatenate([said[near, :4], said[open_, :4], np.repeat(said[first, :4], PARTS, axis=0)])
        kind = np.repeat(["answered", "waiting", "reply"], [len(x) for x in parts])
        seconds = (said[after[near], 2] - said[near, 2]) // 1_000_000
        out = _told(rows, np.concatenate(parts), kind, key[0], expiredTimerInfo.getExpiryTimeInMs())
        out["response_time_secs"] = pd.array([*seconds.tolist(), *[None] * (len(rows) - len(near))], "Int64")
        yield out

    def close(self) -> None:
        pass


class _Waiting(StatefulProcessor):
    """Waiting messages of a group of customers and part; hours come in order, for they are given out as the watermark passes them."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "nobody boolean, customer long, at long, msg_id long")

    def handleInputRows(self, key, rows, timerValues):
        told = pd.concat(list(rows))
        yield _replies(told[told["kind"] == "answered"])
        told = told[told["kind"] != "answered"]
        if not len(told):
            return
        rows = [*_WHO, "at", "msg_id", "closed"]
        told = told.assign(closed=told["closed_at"].astype("int64"))
        opened, reply = told[told["kind"] == "waiting"][rows], told[told["kind"] == "reply"]
        if self.waiting.exists():
            before = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=rows[:-1])
            opened = pd.concat([before.assign(closed=np.iinfo(np.int64).min), opened])
        # each is answered by the first outbound message of its customer in a later hour
        reply = reply[[*_WHO, "closed", "at"]].rename(columns={"at": "reply_at"}).sort_values("closed").astype({"nobody": bool, "customer": "int64", "reply_at": "int64"})
        opened = opened.astype({"nobody": bool, "customer": "int64", "at": "int64", "msg_id": "int64", "closed": "int64"}).sort_values("closed")
        reply["place"] = np.arange(len(reply))  # what is not met makes times floats, which lose microseconds
        met = pd.merge_asof(opened, reply[[*_WHO, "closed", "place"]], on="closed", by=_WHO, direction="forward", allow_exact_matches=False)
        found = met["place"].notna()
        answered = met[found]
        seconds = (reply["reply_at"].to_numpy()[answered["place"].to_numpy(np.int64)] - answered["at"].to_numpy()) // 1_000_000
        left = met[~found]
        if len(left):
            self.waiting.put(list(zip(*[left[c].tolist() for c in rows[:-1]], strict=True)))
            for day in np.unique(-(-left["at"].to_numpy() // DAY_US)).tolist():
                self.handle.registerTimer(day * DAY_US // 1000 + self.keep_ms)
        else:
            self.waiting.clear()
        yield _replies(answered.assign(response_time_secs=seconds))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = (expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms) * 1000
        if self.waiting.exists():
            left = [tuple(r) for r in self.waiting.get() if r[2] > limit + 999]
            self.waiting.put(left) if left else self.waiting.clear()
        yield _replies(pd.DataFrame({c: [] for c in (*_WHO, "msg_id", "response_time_secs")}))

    def close(self) -> None:
        pass


def _told(rows: np.ndarray, part, kind, group: int, closed_ms: int = 0) -> pd.DataFrame:
    """Rows (nobody, customer, at, msg_id) as the hours give them out."""
    return pd.DataFrame(
        {
            "grp": np.full(len(rows), group, np.int32), "part": np.array(part, np.int64), "kind": np.array(kind, object), "nobody": rows[:, 0].astype(bool), "customer": rows[:, 1], "msg_id": rows[:, 3], "at": rows[:, 2],
            "response_time_secs": pd.array([None] * len(rows), "Int64"), "closed_at": pd.Series([pd.Timestamp(closed_ms, unit="ms")] * len(rows), dtype="datetime64[ns]"),
        }
    )


def _replies(rows: pd.DataFrame) -> pd.DataFrame:
    customer = rows["customer"].astype("int64").astype("Int64").mask(rows["nobody"].astype(bool))
    return pd.DataFrame({"customer_id": customer, "msg_id": rows["msg_id"].astype("int64"), "response_time_secs": rows["response_time_secs"].astype("int64")})


def stream_response_times(messages: DataFrame, delay: str = "1 day", keep_days: int = 30) -> DataFrame:
    """Reply delay of answered inbound messages, equal to C5 in whatever order the messages come within ``delay``.

    State is kept per group of customers and hour until the watermark passes the hour, so a late reply or an earlier message that comes after
    a later one finds its place; what lies behind the watermark is late. There are GROUPS groups, so that the number of states, each of which
    costs some calls, is set by the hours and not by the messages. What an hour leaves open waits in PARTS
    parts per group for the first outbound message of its customer in a later hour, of which every part gets a row. So no
    customer's messages are in one state, and what waits is dealt over tasks. Messages still waiting ``keep_days``
    after the watermark, up to the end of their day, are given up. Replies are given out when the watermark passes their hour.
    The states need the RocksDB store, which this sets for the session.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = with_event_time(messages.select("customer_id", "msg_id", "direction", "timestamp"), delay)
    rows = timed.select(
        F.pmod(F.xxhash64("customer_id"), F.lit(GROUPS)).cast("int").alias("grp"), F.date_trunc("hour", "timestamp").alias("hour"), F.isnull("customer_id").alias("nobody"),
        F.coalesce(F.col("customer_id").cast("long"), F.lit(0).cast("long")).alias("customer"), F.unix_micros("timestamp").alias("at"), "msg_id", "direction", "timestamp",
    )
    hours = rows.groupBy("grp", "hour").transformWithStateInPandas(
        _Hour(), "grp int, part long, kind string, nobody boolean, customer long, msg_id long, at long, response_time_secs long, closed_at timestamp", "Append", "EventTime", eventTimeColumnName="closed_at"
    )
    return hours.groupBy("grp", "part").transformWithStateInPandas(_Waiting(keep_days * 86_400_000), "customer_id long, msg_id long, response_time_secs long", "Append", "EventTime")
