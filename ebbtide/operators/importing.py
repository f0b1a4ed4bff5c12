"""Validation and import of customer, transaction and message files (A operators).

Duplicate checks compare each row with the first row of its key. The first row comes from a
partial aggregate and the join back is on key and row number, so a key repeated in a third of
the file does not pile up in one task.
"""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.skew import mark_first
from ebbtide.functions.text import hash_phone, is_trainable, normalize_phone, normalize_text, parse_datetime
from ebbtide.operators.identity import link_messages
from ebbtide.session import cut_lineage
from ebbtide.sources.imports import plain_name

# Required columns and accepted codes of the three import files.
CUSTOMER_COLUMNS = ("customer_id", "customer_name", "phone_number", "join_date")
TRANSACTION_COLUMNS = ("transaction_id", "customer_id", "transaction_date", "transaction_amount", "service_type", "transaction_status")
MESSAGE_COLUMNS = ("message_id", "phone_number", "message_timestamp", "sender_type", "message_text")
TRANSACTION_STATUSES = ("completed", "cancelled", "refunded")
DIRECTION_OF_SENDER = {"customer": "inbound", "admin": "outbound"}


def cell(name: str) -> Column:
    """A text cell, trimmed; a missing cell is empty text, never the word "nan"."""
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _error_rows(df: DataFrame, row: str, checks: list[tuple[Column, str, Column]]) -> DataFrame:
    found = [F.when(cond, F.struct(F.lit(column).alias("column"), message.alias("message"))) for cond, column, message in checks]
    return df.select(row, F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select(row, "e.column", "e.message")


def _flag_known(df: DataFrame, key: str, known: DataFrame, known_key: str, flag: str) -> DataFrame:
    keys = known.filter(F.col(known_key).isNotNull()).select(F.col(known_key).alias(key)).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def validate_required_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """A2: one row per missing required column."""
    missing = [(0, c, f"Required column '{c}' not found in CSV") for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(missing, "row int, column string, message string")


def missing_columns(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A2 for files: (source_file, column, message) for every required column that the header of a CSV file below ``path`` lacks.

    The header is the first line of a file that is not blank, read from the file's first input split; names are compared as the import
    reads them (lower case, blanks as underscores). A file without any line lacks all columns only if it has a blank one, for a
    file without bytes is not scanned.
    """
    @F.arrow_udf("array<string>")
    def names(lines: pa.Array) -> pa.Array:
        return pa.array([[plain_name(c) for c in next(csv.reader([line or ""]), [])] for line in lines.to_pylist()], pa.list_(pa.string()))

    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("place"))
    first = text.filter("block = 0").groupBy("source_file").agg(F.min_by("line", F.struct(F.length(F.trim("line")) == 0, "place")).alias("line"))
    asked = F.array(*[F.lit(c) for c in required])
    lacking = first.select("source_file", F.explode(F.array_except(asked, names("line"))).alias("column"))
    return lacking.select("source_file", "column", F.concat(F.lit("Required column '"), "column", F.lit("' not found in CSV")).alias("message"))


def validate_customers(df: DataFrame, row: str = "row") -> DataFrame:
    """A4: every error of a customer file; nothing is cut off after the first errors."""
    rows = df.select(row, cell("customer_id").alias("id"), cell("phone_number").alias("raw_phone"), cell("join_date").alias("date"))
    rows = rows.withColumn("_id", F.nullif("id", F.lit(""))).withColumn("_phone", F.when(F.col("raw_phone") != "", normalize_phone(F.col("raw_phone"))))
    rows = mark_first(mark_first(rows, ["_id"], row, "first_id"), ["_phone"], row, "first_phone")
    return _error_rows(rows, row, [
        (F.col("id") == "", "customer_id", F.lit("customer_id is empty")),
        ((F.col("id") != "") & ~F.col("first_id"), "customer_id", F.concat(F.lit("Duplicate customer_id: "), "id")),
        (F.col("_phone").isNotNull() & ~F.col("first_phone"), "phone_number", F.lit("Duplicate phone_number")),
        ((F.col("date") != "") & parse_datetime(F.col("date")).isNull(), "join_date", F.concat(F.lit("Invalid date format: "), "date")),
    ])


def validate_transactions(df: DataFrame, customers: DataFrame, row: str = "row") -> DataFrame:
    """A5: ids, known customers (``external_id``), amounts, statuses and dates."""
    rows = df.select(
        row, cell("transaction_id").alias("id"), cell("customer_id").alias("cid"), cell("transaction_amount").alias("amount"),
        F.lower(cell("transaction_status")).alias("status"), cell("transaction_date").alias("date"),
    ).withColumn("_id", F.nullif("id", F.lit("")))
    rows = _flag_known(mark_first(rows, ["_id"], row, "first_id"), "cid", customers, "external_id", "known")
    number = F.when(F.col("amount") == "", F.lit(0.0)).otherwise(F.col("amount").try_cast("double"))
    return _error_rows(rows, row, [
        (F.col("id") == "", "transaction_id", F.lit("Empty transaction_id")),
        ((F.col("id") != "") & ~F.col("first_id"), "transaction_id", F.lit("Duplicate transaction_id")),
        ((F.col("cid") != "") & ~F.col("known"), "customer_id", F.concat(F.lit("Customer ID not found: "), "cid")),
        (number < 0, "transaction_amount", F.lit("Amount must be >= 0")),
        (number.isNull(), "transaction_amount", F.concat(F.lit("Invalid amount: "), "amount")),
        ((F.col("status") != "") & ~F.col("status").isin(*TRANSACTION_STATUSES), "transaction_status", F.concat(F.lit("Invalid status: "), "status")),
        ((F.col("date") != "") & parse_datetime(F.col("date")).isNull(), "transaction_date", F.concat(F.lit("Invalid date: "), "date")),
    ])


def validate_messages(df: DataFrame, customers: DataFrame, row: str = "row") -> DataFrame:
    """Ids, known phones (``phone_hash``), sender types, timestamps and texts."""
    rows = df.select(
        row, cell("message_id").alias("id"), cell("phone_number").alias("phone"), F.lower(cell("sender_type")).alias("sender"),
        cell("message_timestamp").alias("ts"), cell("message_text").alias("text"),
    ).withColumn("_id", F.nullif("id", F.lit(""))).withColumn("_hash", hash_phone(F.col("phone")))
    rows = _flag_known(mark_first(rows, ["_id"], row, "first_id"), "_hash", customers, "phone_hash", "known")
    return _error_rows(rows, row, [
        (F.col("id") == "", "message_id", F.lit("Empty message_id")),
        ((F.col("id") != "") & ~F.col("first_id"), "message_id", F.lit("Duplicate message_id")),
        (F.col("phone") == "", "phone_number", F.lit("Empty phone_number")),
        ((F.col("phone") != "") & ~F.col("known"), "phone_number", F.lit("Phone number not found in customer_master")),
        ((F.col("sender") != "") & ~F.col("sender").isin(*DIRECTION_OF_SENDER), "sender_type", F.concat(F.lit("Invalid sender_type: "), "sender")),
        ((F.col("ts") != "") & parse_datetime(F.col("ts")).isNull(), "message_timestamp", F.concat(F.lit("Invalid timestamp: "), "ts")),
        (F.col("text") == "", "message_text", F.lit("Empty message_text")),
    ])


def validation_counts(df: DataFrame, errors: DataFrame, row: str = "row") -> DataFrame:
    """Valid and invalid row counts of a validated file."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return errors.agg(F.countDistinct(row).alias("invalid_rows"), F.count(F.lit(1)).alias("errors")).select(
        (total - F.col("invalid_rows")).alias("valid_rows"), "invalid_rows", "errors"
    )


def import_summary(df: DataFrame, columns: tuple[str, ...], id_col: str, ts_col: str | None = None) -> DataFrame:
    """A10: missing cells per column, repeated ids (a missing id repeats too) and unreadable times."""
    n, nulls = F.count(F.lit(1)), F.count_if(F.col(id_col).isNull())
    repeats = n - F.countDistinct(id_col) - F.when(nulls > 0, 1).otherwise(0)
    bad = F.count_if(F.col(ts_col).isNotNull() & parse_datetime(F.col(ts_col)).isNull()) if ts_col else F.lit(0)
    one = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns],
        repeats.cast("bigint").alias("_repeats"), bad.cast("bigint").alias("_bad"),
    )

    def entry(metric: str, column: str, value: str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(column).alias("column"), F.col(value).alias("value"))

    entries = [entry("missing", c, f"m_{c}") for c in columns]
    entries += [entry("duplicates", id_col, "_repeats"), entry("invalid_timestamps", ts_col or "", "_bad")]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _first_two(rows: DataFrame, key: str, row: str, one: str, two: str) -> DataFrame:
    """Rows with the least and second least ``row`` of their key as columns; partial minima, so no key's rows meet in one task."""
    known = rows.filter(F.col(key).isNotNull())
    first = known.groupBy(key).agg(F.min(row).alias(one))
    second = known.join(first, key).filter(F.col(row) > F.col(one)).groupBy(key).agg(F.min(row).alias(two))
    return rows.join(first.join(second, key, "left"), key, "left")


def _chained(undecided: DataFrame, row: str) -> DataFrame:
    """Rows of ``undecided`` that a reader keeps, as far as chains of single conflicts tell.

    A row without an earlier rival for its id or phone is kept. A row with one such rival is kept if the rival is not, and that
    rival's fate may hang on one rival again: such rows point at their rival, and pointers are doubled until they reach a row
    that is kept or has several rivals. A chain of n conflicts is so decided by log2(n) joins. Rows behind one
    with several rivals wait.
    """
    both = _first_two(_first_two(undecided, "_id", row, "_i1", "_i2"), "_hash", row, "_h1", "_h2")
    r = F.col(row)
    by_id, by_phone = (F.when(F.col(one).isNull() | (r == F.col(one)), F.lit(0)).when(r == F.col(two), F.lit(1)).otherwise(2) for one, two in (("_i1", "_i2"), ("_h1", "_h2")))
    same = (by_id == 1) & (by_phone == 1) & (F.col("_i1") == F.col("_h1"))
    rivals = F.when(same, F.lit(1)).otherwise(by_id + by_phone)
    ahead = F.when(rivals == 1, F.when(by_id == 1, F.col("_i1")).otherwise(F.col("_h1")))
    state = cut_lineage(both.select(row, "_id", "_hash", F.when(rivals == 0, F.lit(True)).alias("_kept"), ahead.alias("_ahead"), F.lit(1).alias("_steps")))
    while not state.filter(F.col("_kept").isNull() & F.col("_ahead").isNotNull()).isEmpty():
        told = state.select(F.col(row).alias("_ahead"), F.col("_kept").alias("_k"), F.col("_ahead").alias("_far"), F.col("_steps").alias("_s"))
        near = state.join(told, "_ahead", "left")
        settled = F.when(F.col("_kept").isNull() & F.col("_k").isNotNull(), F.when(F.col("_steps") % 2 == 0, F.col("_k")).otherwise(~F.col("_k"))).otherwise(F.col("_kept"))
        # a pointer that is settled, or has come to a row with several rivals, ends
        on = F.when(F.col("_kept").isNull() & F.col("_k").isNull(), F.col("_far"))
        state = cut_lineage(near.select(row, "_id", "_hash", settled.alias("_kept"), on.alias("_ahead"), (F.col("_steps") + F.coalesce("_s", F.lit(0))).alias("_steps")))
    return state.filter("_kept").select(row, "_id", "_hash")


def _greedy_first(rows: DataFrame, row: str) -> DataFrame:
    """Rows a reader going top to bottom would keep when id and phone must both be new.

    A dropped row must not block a later one, so first rows of both their groups are accepted,
    what conflicts with them is dropped, and the rest is looked at again until nothing is left. After the first pass only
    chains of conflicts remain, which :func:`_chained` decides at once where each row has one rival; passes are as many as
    rows with several undecided rivals follow each other.
    """
    undecided = cut_lineage(rows.select(row, "_id", "_hash"))
    accepted = None
    while True:
        if accepted is None:
            marked = mark_first(mark_first(undecided, ["_id"], row, "_f1"), ["_hash"], row, "_f2")
            winners = cut_lineage(marked.filter(F.col("_f1") & (F.col("_hash").isNull() | F.col("_f2"))).select(row, "_id", "_hash"))
        else:
            winners = _chained(undecided, row)
        accepted = winners if accepted is None else accepted.unionByName(winners)
        undecided = cut_lineage(
            undecided.join(winners.select("_id"), "_id", "left_anti")
            .join(winners.filter("_hash IS NOT NULL").select("_hash"), "_hash", "left_anti")
        )
        if undecided.isEmpty():
            return accepted


def import_customers(df: DataFrame, existing: DataFrame, row: str = "row") -> DataFrame:
    """Typed customer rows with an outcome; kept rows are first in both id and phone."""
    rows = df.select(
        row, cell("customer_id").alias("id"), cell("customer_name").alias("raw_name"),
        hash_phone(cell("phone_number")).alias("_hash"), parse_datetime(cell("join_date")).alias("created_at"),
    ).withColumn("_id", F.nullif("id", F.lit("")))
    rows = _flag_known(rows, "_id", existing, "external_id", "known_id")
    rows = _flag_known(rows, "_hash", existing, "phone_hash", "known_phone")
    fresh = rows.filter(F.col("_id").isNotNull() & ~F.col("known_id") & ~F.col("known_phone") & F.col("created_at").isNotNull())
    kept = cut_lineage(_greedy_first(fresh, row))
    by_id = kept.select("_id", F.col(row).alias("_kept_id"))
    by_phone = kept.filter("_hash IS NOT NULL").select("_hash", F.col(row).alias("_kept_phone"))
    seen = rows.join(by_id, "_id", "left").join(by_phone, "_hash", "left")
    earlier = F.coalesce((F.col("_kept_id") < F.col(row)) | F.lit(False), F.lit(False)) | F.coalesce(F.col("_kept_phone") < F.col(row), F.lit(False))
    outcome = (
        F.when(F.col("_id").isNull(), "skipped_empty_id")
        .when(F.col("known_id") | F.col("known_phone") | earlier, "duplicate")
        .when(F.col("created_at").isNull(), "skipped_invalid_date")
        .otherwise("imported")
    )
    return seen.select(
        row, F.sha2(F.concat(F.lit("customer:"), "id"), 256).alias("customer_id"), F.col("id").alias("external_id"),
        F.coalesce(F.nullif("raw_name", F.lit("")), F.concat(F.lit("Customer "), "id")).alias("name"),
        F.col("_hash").alias("phone_hash"), "created_at", outcome.alias("outcome"),
    )


def import_transactions(df: DataFrame, customers: DataFrame, row: str = "row") -> DataFrame:
    """Typed transactions with an outcome. An id counts as seen even if its first row is unusable."""
    rows = df.select(
        row, cell("transaction_id").alias("id"), cell("customer_id").alias("external_id"), cell("transaction_amount").alias("raw_amount"),
        F.lower(cell("transaction_status")).alias("raw_status"), parse_datetime(cell("transaction_date")).alias("tx_date"),
        F.coalesce(F.nullif(cell("service_type"), F.lit("")), F.lit("unknown")).alias("service_type"),
    ).withColumn("_id", F.nullif("id", F.lit("")))
    ids = customers.filter(F.col("external_id").isNotNull()).select("external_id", "customer_id")
    rows = mark_first(rows, ["_id"], row, "first_id").join(ids, "external_id", "left")
    amount = F.when(F.col("raw_amount") == "", F.lit("0")).otherwise(F.col("raw_amount")).try_cast("decimal(12,2)")
    outcome = (
        F.when(~F.col("first_id"), "duplicate")
        .when(F.col("customer_id").isNull(), "skipped_unknown_customer")
        .when(F.col("tx_date").isNull(), "skipped_invalid_date")
        .when(amount.isNull(), "skipped_invalid_amount")
        .otherwise("imported")
    )
    return rows.select(
        row, F.sha2(F.concat(F.lit("tx:"), "id"), 256).alias("tx_id"), "customer_id", "tx_date", "service_type", amount.alias("amount"),
        F.when(F.col("raw_status").isin(*TRANSACTION_STATUSES), F.col("raw_status")).otherwise("completed").alias("status"),
        outcome.alias("outcome"),
    )


def import_messages(df: DataFrame, customers: DataFrame, row: str = "row") -> DataFrame:
    """Typed messages with an outcome; direction from the sender type, inbound when unknown."""
    rows = df.select(
        row, cell("message_id").alias("id"), hash_phone(cell("phone_number")).alias("phone_number"), F.lower(cell("sender_type")).alias("sender_type"),
        parse_datetime(cell("message_timestamp")).alias("timestamp"), F.nullif(cell("message_text"), F.lit("")).alias("text"),
    ).withColumn("_id", F.nullif("id", F.lit("")))
    rows = _flag_known(mark_first(rows, ["_id"], row, "first_id"), "phone_number", customers, "phone_hash", "known")
    direction = F.lit("inbound")
    for sender, way in DIRECTION_OF_SENDER.items():
        direction = F.when(F.col("sender_type") == sender, way).otherwise(direction)
    outcome = (
        F.when(~F.col("first_id"), "duplicate")
        .when(F.col("phone_number").isNull(), "skipped_empty_phone")
        .when(~F.col("known"), "skipped_unknown_phone")
        .when(F.col("timestamp").isNull(), "skipped_invalid_timestamp")
        .otherwise("imported")
    )
    return rows.select(
        row, F.sha2(F.concat(F.lit("msg:"), "id"), 256).alias("msg_id"), "phone_number", direction.alias("direction"), "text", "timestamp",
        F.create_map(F.lit("message_id"), "id", F.lit("sender_type"), "sender_type").alias("raw_meta"), outcome.alias("outcome"),
    )


def import_and_link_messages(df: DataFrame, customers: DataFrame, links: DataFrame, row: str = "row") -> DataFrame:
    """A9 followed by B1: links of the messages this file adds."""
    added = import_messages(df, customers, row).filter("outcome = 'imported'")
    return link_messages(added, customers, links)


def outcome_counts(imported: DataFrame) -> DataFrame:
    return imported.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def new_chat_messages(parsed: DataFrame, existing: DataFrame, salt: str = "") -> DataFrame:
    """Parsed chat messages not stored yet, once each by sender hash, time and text."""
    key = ["phone_number", "timestamp", "text"]
    hashed = parsed.withColumn("phone_number", F.sha2(F.concat(F.lit(salt), F.regexp_replace("sender", "[ -]", "")), 256))
    return hashed.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def ingest_chat_stats(parsed: DataFrame, existing: DataFrame, salt: str = "") -> DataFrame:
    """Total, new and duplicate messages and distinct senders, as one row."""
    added = new_chat_messages(parsed, existing, salt).agg(F.count(F.lit(1)).alias("n")).scalar()
    return parsed.agg(F.count(F.lit(1)).alias("total_messages"), F.countDistinct("sender").alias("unique_senders")).select(
        "total_messages", added.alias("new_messages"), (F.col("total_messages") - added).alias("duplicate_messages"), "unique_senders"
    )


def load_corpus(df: DataFrame, direction: str | None = None, min_chars: int = 15, order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Normalised trainable texts from the first of the columns text, message or content."""
    by_lower = {c.lower(): c for c in df.columns}
    column = next((by_lower[c] for c in ("text", "message", "content") if c in by_lower), None)
    if column is None:
        raise ValueError(f"no text, message or content column in {df.columns}")
    if direction is not None and "direction" in by_lower:
        df = df.filter(F.lower(by_lower["direction"]) == direction.lower())
    kept = df.filter(is_trainable(F.col(column), min_chars)).withColumn("corpus_text", normalize_text(F.col(column)))
    if limit is not None:
        kept = kept.orderBy(order_by or column).limit(limit)
    return kept


def ingest_backlog_stats(messages: DataFrame, links: DataFrame, features: DataFrame) -> DataFrame:
    """How many messages wait for linking and for feature extraction."""
    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    raw, linked, featured = F.col("raw_messages"), size(links), size(features)
    return messages.agg(F.count(F.lit(1)).alias("raw_messages")).select(
        raw, linked.alias("linked_messages"), (raw - linked).alias("unlinked_messages"), featured.alias("feature_extracted"),
        (linked - featured).alias("pending_features"),
    )
