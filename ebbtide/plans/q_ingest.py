"""Queries over import, identity and message operators (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions import text as T
from ebbtide.functions import vectors as V
from ebbtide.operators import identity as B
from ebbtide.operators import importing as A
from ebbtide.operators import messages as C
from ebbtide.plans.bindings import Tables, add_cte, r6
from ebbtide.plans.registry import query
from ebbtide.sources.chat_export import parse_chat_export, read_export_lines
from ebbtide.sources.imports import read_import_csv, scratch_dir, write_snapshot

# Patterns of common syllables, so that flags are found in the invented texts as well.
COMMON_COMPLAINT = ("le", "la (le|la)", "de", "ion")
COMMON_REFUND = ("the", "et (la|le)")


# ---------------------------------------------------------------------------------------------
# Import frames with defects spread over the given rows, as DataFrames and as SQL
# ---------------------------------------------------------------------------------------------
def customer_file(t: Tables):
    k = F.col("c_custkey")
    ident = F.when(k % 50 == 0, "").when(k % 60 == 1, F.concat(F.lit("C"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("C"), k.cast("string")))
    owner = F.when((k % 60 == 2) | (k % 70 == 3), k - 1).otherwise(k)
    phone = F.concat(F.lit("08"), F.lpad(owner.cast("string"), 12, "0"))
    date = F.when(k % 70 == 5, "not a date").when(k % 2 == 0, "2024-03-09 10:15:00").otherwise("17/02/2024")
    return t.read("customer").select((k + 2).alias("row"), ident.alias("customer_id"), F.when(k % 90 != 8, F.col("c_name")).alias("customer_name"),
                                     F.when(k % 45 != 7, phone).alias("phone_number"), date.alias("join_date"))


add_cte("customer_file", "", """
    SELECT c_custkey + 2 AS row, CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 60 = 1 THEN 'C' || (c_custkey - 1) ELSE 'C' || c_custkey END AS customer_id,
           CASE WHEN c_custkey % 90 <> 8 THEN c_name END AS customer_name,
           CASE WHEN c_custkey % 45 <> 7 THEN '08' || lpad(CAST(CASE WHEN c_custkey % 60 = 2 OR c_custkey % 70 = 3 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR), 12, '0') END AS phone_number,
           CASE WHEN c_custkey % 70 = 5 THEN 'not a date' WHEN c_custkey % 2 = 0 THEN '2024-03-09 10:15:00' ELSE '17/02/2024' END AS join_date FROM customer""")
add_cte("known", "customers", "SELECT customer_id, 'C' || customer_id AS external_id, sha256('62' || substr(phone, 2)) AS phone_hash, is_provisional FROM customers")


def known_customers(t: Tables):
    return t.customers().select("customer_id", F.concat(F.lit("C"), F.col("customer_id").cast("string")).alias("external_id"), T.hash_phone(F.col("phone")).alias("phone_hash"), "is_provisional")


def transaction_file(t: Tables):
    k = F.col("o_orderkey")
    ident = F.when(k % 50 == 0, "").when(k % 60 == 1, F.concat(F.lit("T"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("T"), k.cast("string")))
    cust = F.when(k % 40 == 7, "C999999999999").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    amount = F.when(k % 70 == 3, "-5").when(k % 70 == 4, "abc").when(k % 70 == 5, "").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    status = F.when(k % 80 == 9, "Unknown").when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "cancelled").otherwise("refunded")
    date = F.when(k % 90 == 11, "bad").when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    return t.read("orders").select((k + 2).alias("row"), ident.alias("transaction_id"), cust.alias("customer_id"), date.alias("transaction_date"),
                                   amount.alias("transaction_amount"), F.col("o_orderpriority").alias("service_type"), status.alias("transaction_status"))


add_cte("transaction_file", "", """
    SELECT o_orderkey + 2 AS row, CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 60 = 1 THEN 'T' || (o_orderkey - 1) ELSE 'T' || o_orderkey END AS transaction_id,
           CASE WHEN o_orderkey % 40 = 7 THEN 'C999999999999' ELSE 'C' || o_custkey END AS customer_id,
           CASE WHEN o_orderkey % 90 = 11 THEN 'bad' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M') END AS transaction_date,
           CASE o_orderkey % 70 WHEN 3 THEN '-5' WHEN 4 THEN 'abc' WHEN 5 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS transaction_amount,
           o_orderpriority AS service_type, o_orderdate AS real_date, CAST(o_totalprice AS DECIMAL(12,2)) AS real_amount,
           CASE WHEN o_orderkey % 80 = 9 THEN 'Unknown' WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' THEN 'cancelled' ELSE 'refunded' END AS transaction_status FROM orders""")


def message_file(t: Tables):
    c, k = t.read("conversations"), F.col("conv_id") * 1000 + F.col("turn")
    ident = F.when(F.col("turn") == 5, F.concat(F.lit("M"), (k - 1).cast("string"))).when(F.col("conv_id") % 20 == 4, "").otherwise(F.concat(F.lit("M"), k.cast("string")))
    phone = F.when(F.col("turn") == 3, "").otherwise(F.concat(F.lit("+62 8"), F.lpad((F.col("conv_id") * 20).cast("string"), 12, "0")))
    sender = F.when(F.col("role") == "user", "Customer").when(F.col("role") == "assistant", "admin").otherwise("system")
    ts = F.when(F.col("conv_id") % 15 == 2, "yesterday").otherwise(F.concat(F.lit("2024-05-06 07:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0")))
    return c.select(k.alias("row"), ident.alias("message_id"), phone.alias("phone_number"), ts.alias("message_timestamp"), sender.alias("sender_type"), F.col("text").alias("message_text"))


add_cte("message_file", "", """
    SELECT conv_id * 1000 + turn AS row, CASE WHEN turn = 5 THEN 'M' || (conv_id * 1000 + turn - 1) WHEN conv_id % 20 = 4 THEN '' ELSE 'M' || (conv_id * 1000 + turn) END AS message_id,
           CASE WHEN turn = 3 THEN '' ELSE '+62 8' || lpad(CAST(conv_id * 20 AS VARCHAR), 12, '0') END AS phone_number,
           CASE WHEN conv_id % 15 = 2 THEN 'yesterday' ELSE '2024-05-06 07:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') END AS message_timestamp,
           CASE role WHEN 'user' THEN 'Customer' WHEN 'assistant' THEN 'admin' ELSE 'system' END AS sender_type, text AS message_text,
           CASE WHEN turn = 3 THEN NULL ELSE sha256('628' || lpad(CAST(conv_id * 20 AS VARCHAR), 12, '0')) END AS hash FROM conversations""")


# ---------------------------------------------------------------------------------------------
# A: import
# ---------------------------------------------------------------------------------------------
@query("read_import_csv", "SELECT CAST(row AS VARCHAR) AS row, nullif(customer_id, '') AS customer_id, customer_name, phone_number, join_date FROM customer_file", "customer_file")
def _(t):
    folder = scratch_dir(t.spark, "csv")
    customer_file(t).withColumnRenamed("customer_name", "Customer Name").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)
    return read_import_csv(t.spark, folder).drop("source_file", "source_row")


@query("read_import_csv_quoted", """
    SELECT CAST(row AS VARCHAR) AS row, nullif(message_id, '') AS message_id, sender_type, 'first "line",' || chr(10) || coalesce(message_text, '') || chr(10) || ', last' AS message_text FROM message_file""", "message_file")
def _(t):
    """Messages with quotes, commas and line breaks in their cells, from one file that several tasks read."""
    folder = scratch_dir(t.spark, "quoted-csv")
    text = F.concat(F.lit('first "line",\n'), F.coalesce("message_text", F.lit("")), F.lit("\n, last"))
    rows = message_file(t).select("row", "message_id", "sender_type", text.alias("message_text"))
    rows.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return read_import_csv(t.spark, folder, multi_line=True).drop("source_file", "source_row")


@query("validate_required_columns", """
    SELECT c_mktsegment AS file, c AS "column", 'Required column ''' || c || ''' not found in CSV' AS message
    FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), (SELECT unnest(['customer_id', 'customer_name', 'phone_number', 'join_date']) AS c)
    WHERE c = 'customer_id' AND n % 5 = 0 OR c = 'phone_number' AND n % 2 = 0 OR c = 'join_date' AND n % 3 = 0""")
def _(t):
    """One import file per market segment; its number of customers decides which columns its header lacks."""
    folder = scratch_dir(t.spark, "segment-files")
    rows = t.read("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("Customer Name"), F.col("c_nationkey").alias(" Phone_Number "), F.lit("2024-01-01").alias("join_date"), "c_mktsegment")
    for r in rows.groupBy("c_mktsegment").count().collect():  # a row per segment
        n, drop = r["count"], ["c_mktsegment"]
        drop += [c for c, k in (("customer_id", 5), (" Phone_Number ", 2), ("join_date", 3)) if n % k == 0]
        rows.filter(F.col("c_mktsegment") == r["c_mktsegment"]).drop(*drop).coalesce(1).write.option("header", True).option("quoteAll", True).csv(f"{folder}/{r['c_mktsegment']}")
    found = A.missing_columns(t.spark, f"{folder}/*", A.CUSTOMER_COLUMNS)
    return found.select(F.regexp_extract("source_file", "/([^/]+)/[^/]+$", 1).alias("file"), "column", "message")


@query("parse_datetime_iso", """
    SELECT event_id, ts AS parsed_iso, ts AS parsed_named, date_trunc('second', ts) AS parsed_zoned FROM events""")
def _(t):
    """ISO with T and microseconds, English month names, and a zone mark, for the time of every event."""
    e = t.read("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss.SSSSSS"))
    named = F.concat_ws(" ", F.date_format("ts", "d"), F.date_format("ts", "MMMM"), F.date_format("ts", "yyyy"), F.date_format("ts", "HH:mm:ss.SSSSSS"))
    zoned = F.concat(F.date_format("ts", "yyyy/M/d HH:mm:ss"), F.lit("Z"))
    return e.select("event_id", T.parse_datetime(iso).alias("parsed_iso"), T.parse_datetime(named).alias("parsed_named"), T.parse_datetime(zoned).alias("parsed_zoned"))


@query("parse_datetime_multi", """
    SELECT row, CASE WHEN transaction_date = 'bad' THEN NULL ELSE CAST(CAST(real_date AS DATE) AS TIMESTAMP) END AS parsed FROM transaction_file""", "transaction_file")
def _(t):
    return transaction_file(t).select("row", T.parse_datetime(F.col("transaction_date")).alias("parsed"))


_CUSTOMER_ERRORS = """
    SELECT row, 'customer_id' AS "column", 'customer_id is empty' AS message FROM customer_file WHERE customer_id = ''
    UNION ALL SELECT row, 'customer_id', 'Duplicate customer_id: ' || customer_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY row) AS n FROM customer_file WHERE customer_id <> '') WHERE n > 1
    UNION ALL SELECT row, 'phone_number', 'Duplicate phone_number' FROM (SELECT *, row_number() OVER (PARTITION BY phone_number ORDER BY row) AS n FROM customer_file WHERE phone_number IS NOT NULL) WHERE n > 1
    UNION ALL SELECT row, 'join_date', 'Invalid date format: not a date' FROM customer_file WHERE join_date = 'not a date'"""


@query("validate_customers", _CUSTOMER_ERRORS, "customer_file")
def _(t):
    return A.validate_customers(customer_file(t))


@query("validation_counts", f"SELECT (SELECT count(*) FROM customer_file) - count(DISTINCT row) AS valid_rows, count(DISTINCT row) AS invalid_rows, count(*) AS errors FROM ({_CUSTOMER_ERRORS})", "customer_file")
def _(t):
    f = customer_file(t)
    return A.validation_counts(f, A.validate_customers(f))


@query("validate_transactions", """
    SELECT row, 'transaction_id' AS "column", 'Empty transaction_id' AS message FROM transaction_file WHERE transaction_id = ''
    UNION ALL SELECT row, 'transaction_id', 'Duplicate transaction_id' FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY row) AS n FROM transaction_file WHERE transaction_id <> '') WHERE n > 1
    UNION ALL SELECT row, 'customer_id', 'Customer ID not found: ' || customer_id FROM transaction_file WHERE customer_id NOT IN (SELECT external_id FROM known)
    UNION ALL SELECT row, 'transaction_amount', 'Amount must be >= 0' FROM transaction_file WHERE transaction_amount = '-5'
    UNION ALL SELECT row, 'transaction_amount', 'Invalid amount: abc' FROM transaction_file WHERE transaction_amount = 'abc'
    UNION ALL SELECT row, 'transaction_status', 'Invalid status: unknown' FROM transaction_file WHERE transaction_status = 'Unknown'
    UNION ALL SELECT row, 'transaction_date', 'Invalid date: bad' FROM transaction_file WHERE transaction_date = 'bad'""", "transaction_file known")
def _(t):
    return A.validate_transactions(transaction_file(t), known_customers(t))


@query("validate_messages", """
    SELECT row, 'message_id' AS "column", 'Empty message_id' AS message FROM message_file WHERE message_id = ''
    UNION ALL SELECT row, 'message_id', 'Duplicate message_id' FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY row) AS n FROM message_file WHERE message_id <> '') WHERE n > 1
    UNION ALL SELECT row, 'phone_number', 'Empty phone_number' FROM message_file WHERE phone_number = ''
    UNION ALL SELECT row, 'phone_number', 'Phone number not found in customer_master' FROM message_file WHERE phone_number <> '' AND hash NOT IN (SELECT phone_hash FROM known)
    UNION ALL SELECT row, 'sender_type', 'Invalid sender_type: system' FROM message_file WHERE sender_type = 'system'
    UNION ALL SELECT row, 'message_timestamp', 'Invalid timestamp: yesterday' FROM message_file WHERE message_timestamp = 'yesterday'
    UNION ALL SELECT row, 'message_text', 'Empty message_text' FROM message_file WHERE trim(coalesce(message_text, '')) = ''""", "message_file known")
def _(t):
    return A.validate_messages(message_file(t), known_customers(t))


_BUILDING = "SELECT external_id, phone_hash FROM known k JOIN customer c ON c.c_custkey = k.customer_id WHERE c.c_mktsegment = 'BUILDING'"


@query("import_customers", f"""
    WITH RECURSIVE ex AS ({_BUILDING}), f AS (SELECT *, sha256('62' || substr(phone_number, 2)) AS hash, customer_id IN (SELECT external_id FROM ex) OR
           coalesce(sha256('62' || substr(phone_number, 2)) IN (SELECT phone_hash FROM ex), false) AS known_before FROM customer_file),
    c AS (SELECT *, row_number() OVER (ORDER BY row) AS i FROM f WHERE customer_id <> '' AND NOT known_before AND join_date <> 'not a date'),
    st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ids, []::VARCHAR[] AS phones, []::BIGINT[] AS keep
           UNION ALL SELECT c.i, CASE WHEN ok THEN list_append(ids, customer_id) ELSE ids END, CASE WHEN ok AND hash IS NOT NULL THEN list_append(phones, hash) ELSE phones END, CASE WHEN ok THEN list_append(keep, row) ELSE keep END
           FROM (SELECT st.*, c.i AS ci, c.customer_id, c.hash, c.row, NOT list_contains(ids, c.customer_id) AND (c.hash IS NULL OR NOT list_contains(phones, c.hash)) AS ok FROM st JOIN c ON c.i = st.i + 1) c2 JOIN (SELECT i FROM c) c ON c.i = c2.ci),
    kept AS (SELECT unnest(keep) AS row FROM (SELECT keep FROM st ORDER BY i DESC LIMIT 1)),
    good AS (SELECT f.row, f.customer_id, f.hash FROM f JOIN kept USING (row))
    SELECT f.row, f.customer_id AS external_id, coalesce(nullif(customer_name, ''), 'Customer ' || f.customer_id) AS name, f.hash AS phone_hash,
           CASE WHEN f.customer_id = '' THEN 'skipped_empty_id'
                WHEN known_before OR EXISTS (SELECT 1 FROM good g WHERE g.row < f.row AND (g.customer_id = f.customer_id OR g.hash = f.hash)) THEN 'duplicate'
                WHEN join_date = 'not a date' THEN 'skipped_invalid_date' ELSE 'imported' END AS outcome FROM f""", "customer_file known")
def _(t):
    building = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("customer_id"))
    out = A.import_customers(customer_file(t), known_customers(t).join(building, "customer_id"))
    return out.select("row", "external_id", "name", "phone_hash", "outcome")


_TX_IMPORT = """
    SELECT f.row, k.customer_id, CASE WHEN transaction_date <> 'bad' THEN CAST(CAST(real_date AS DATE) AS TIMESTAMP) END AS tx_date, service_type,
           CAST(CASE WHEN transaction_amount = 'abc' THEN NULL WHEN transaction_amount = '-5' THEN -5 WHEN transaction_amount = '' THEN 0 ELSE real_amount END AS DOUBLE) AS amount,
           CASE WHEN lower(transaction_status) IN ('completed', 'cancelled', 'refunded') THEN lower(transaction_status) ELSE 'completed' END AS status,
           CASE WHEN transaction_id = '' OR n > 1 THEN 'duplicate' WHEN k.customer_id IS NULL THEN 'skipped_unknown_customer' WHEN transaction_date = 'bad' THEN 'skipped_invalid_date'
                WHEN transaction_amount = 'abc' THEN 'skipped_invalid_amount' ELSE 'imported' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY row) AS n FROM transaction_file) f LEFT JOIN known k ON k.external_id = f.customer_id"""


@query("import_transactions", _TX_IMPORT, "transaction_file known")
def _(t):
    return A.import_transactions(transaction_file(t), known_customers(t)).drop("tx_id").withColumn("amount", F.col("amount").cast("double"))


@query("import_outcome_counts", f"SELECT outcome, count(*) AS rows FROM ({_TX_IMPORT}) GROUP BY 1", "transaction_file known")
def _(t):
    return A.outcome_counts(A.import_transactions(transaction_file(t), known_customers(t)))


@query("import_messages", """
    SELECT f.row, hash AS phone_number, CASE WHEN sender_type = 'admin' THEN 'outbound' ELSE 'inbound' END AS direction,
           CASE WHEN message_timestamp <> 'yesterday' THEN CAST(message_timestamp || ':00' AS TIMESTAMP) END AS timestamp,
           CASE WHEN message_id = '' OR n > 1 THEN 'duplicate' WHEN hash IS NULL THEN 'skipped_empty_phone' WHEN hash NOT IN (SELECT phone_hash FROM known) THEN 'skipped_unknown_phone'
                WHEN message_timestamp = 'yesterday' THEN 'skipped_invalid_timestamp' ELSE 'imported' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY row) AS n FROM message_file) f""", "message_file known")
def _(t):
    return A.import_messages(message_file(t), known_customers(t)).select("row", "phone_number", "direction", "timestamp", "outcome")


@query("import_messages_linked", """
    SELECT link_status, match_method, count(*) AS messages FROM (
        SELECT CASE WHEN k.is_provisional THEN 'provisional' ELSE 'probable' END AS link_status, CASE WHEN k.is_provisional THEN 'phone_provisional' ELSE 'phone_exact' END AS match_method
        FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY row) AS n FROM message_file) f JOIN known k ON k.phone_hash = f.hash
        WHERE message_id <> '' AND n = 1 AND message_timestamp <> 'yesterday') GROUP BY 1, 2""", "message_file known")
def _(t):
    none = t.links().limit(0).select(F.col("msg_id").cast("string").alias("msg_id"))
    return B.linking_run_stats(A.import_and_link_messages(message_file(t), known_customers(t), none))


@query("import_summary", """
    SELECT 'missing' AS metric, c AS "column", CASE c WHEN 'customer_name' THEN (SELECT count(*) FROM customer_file WHERE customer_name IS NULL)
           WHEN 'phone_number' THEN (SELECT count(*) FROM customer_file WHERE phone_number IS NULL) ELSE 0 END AS value
    FROM (SELECT unnest(['customer_id', 'customer_name', 'phone_number', 'join_date']) AS c)
    UNION ALL SELECT 'duplicates', 'phone_number', count(*) - count(DISTINCT coalesce(phone_number, '-')) FROM customer_file
    UNION ALL SELECT 'invalid_timestamps', 'join_date', count(*) FROM customer_file WHERE join_date = 'not a date'""", "customer_file")
def _(t):
    return A.import_summary(customer_file(t), A.CUSTOMER_COLUMNS, "phone_number", "join_date")


def export_lines(t: Tables):
    """The conversations written as one export file each, split into lines; a turn plays the part of an input split."""
    at = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id % 2160 AS INT), CAST(turn AS INT), 0)"), "dd/MM/yy, HH:mm:ss")
    text = F.concat(F.lit("["), at, F.lit("] "), "role", F.lit(": "), "text")
    return t.read("conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("block"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x0B\x1C-\x1F\x85]+|[\s\p{{Z}}\x0B\x1C-\x1F\x85]+$', '', 'g')"
_PARSED = f"""
    SELECT conv_id AS file, turn AS message_block, role AS sender, CASE WHEN role = 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction,
           TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 2160 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS timestamp,
           array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), chr(10)) AS text FROM conversations"""


@query("parse_chat_export", _PARSED)
def _(t):
    return parse_chat_export(export_lines(t), "assistant").select("file", "message_block", "sender", "direction", "timestamp", "text")


@query("parse_chat_export_files", f"SELECT sender, direction, timestamp, text FROM ({_PARSED})")
def _(t):
    """The same export written to files, many conversations in each, and read back by the file reader."""
    folder = scratch_dir(t.spark, "export")
    lines = export_lines(t)
    lines.repartition("file").sortWithinPartitions("file", "block", "line_no").select(F.col("line").alias("value")).write.text(folder)
    return parse_chat_export(read_export_lines(t.spark, folder), "assistant").select("sender", "direction", "timestamp", "text")


@query("ingest_chat_messages", f"""
    WITH p AS ({_PARSED})
    SELECT 2 * count(*) AS total_messages, n.n AS new_messages, 2 * count(*) - n.n AS duplicate_messages, count(DISTINCT sender) AS unique_senders
    FROM p, (SELECT count(*) AS n FROM (SELECT DISTINCT sender, timestamp, text FROM p WHERE sender <> 'assistant')) n GROUP BY n.n""")
def _(t):
    parsed = parse_chat_export(export_lines(t), "assistant")
    stored = parsed.filter("sender = 'assistant'").select(F.sha2("sender", 256).alias("phone_number"), "timestamp", "text")
    return A.ingest_chat_stats(parsed.unionByName(parsed), stored)


@query("normalize_and_hash_phone", """
    SELECT customer_id, '62' || substr(phone, 2) AS digits, sha256('62' || substr(phone, 2)) AS plain_hash, sha256('pepper' || '62' || substr(phone, 2)) AS salted_hash,
           sha256('pepper' || name) AS id_hash FROM customers""", "customers")
def _(t):
    raw = F.concat(F.lit(" "), F.substring("phone", 1, 4), F.lit("-("), F.substring("phone", 5, 20), F.lit(") "))
    c = t.customers().withColumn("raw", raw)
    return c.select("customer_id", T.normalize_phone(F.col("raw")).alias("digits"), T.hash_phone(F.col("raw")).alias("plain_hash"),
                    T.hash_phone(F.col("raw"), "pepper").alias("salted_hash"), T.hash_identifier(F.col("name"), "pepper").alias("id_hash"))


@query("write_snapshot", """
    SELECT as_of_date, count(*) AS rows, round(sum(CASE WHEN as_of_date = as_of THEN 0.5 ELSE avg_sentiment_score END), 6) + 0.0 AS score_sum FROM semantics, anchor_events GROUP BY 1""", "semantics anchor_events")
def _(t):
    folder = scratch_dir(t.spark, "snapshot")
    first = t.semantics()
    write_snapshot(first, folder)
    last = t.anchor("events")
    write_snapshot(first.filter(F.col("as_of_date") == F.lit(last)).withColumn("avg_sentiment_score", F.lit(0.5)), folder)
    return t.spark.read.parquet(folder).groupBy("as_of_date").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("avg_sentiment_score")).alias("score_sum"))


_NORM = r"trim(regexp_replace(text, '[\s\p{Z}\x0B\x1C-\x1F\x85]+', ' ', 'g'))"
_FILLER = "('ok', 'oke', 'iya', 'ya', 'baik', 'sip', 'thanks', 'makasih')"


@query("load_corpus", f"SELECT msg_id, {_NORM} AS corpus_text FROM chats WHERE direction = 'inbound' AND length({_NORM}) >= 15 AND lower({_NORM}) NOT IN {_FILLER}", "chats")
def _(t):
    return A.load_corpus(t.chats().drop("phone"), "inbound").select("msg_id", "corpus_text")


@query("ingest_backlog_stats", """
    SELECT r AS raw_messages, l AS linked_messages, r - l AS unlinked_messages, f AS feature_extracted, l - f AS pending_features
    FROM (SELECT count(*) AS r FROM events), (SELECT count(*) AS l FROM links), (SELECT count(*) AS f FROM message_features WHERE has_complaint)""", "links message_features")
def _(t):
    return A.ingest_backlog_stats(t.read("events"), t.links(), t.message_features().filter("has_complaint"))


# ---------------------------------------------------------------------------------------------
# B: identity, trust, governance
# ---------------------------------------------------------------------------------------------
add_cte("unlinked", "chats known", """
    SELECT c.msg_id, c.timestamp, sha256('62' || substr(c.phone, 2)) AS h, k.customer_id AS cid, k.is_provisional AS prov FROM chats c
    LEFT JOIN known k ON k.phone_hash = sha256('62' || substr(c.phone, 2)) WHERE c.direction = 'inbound'""")
_LINKED = """
    SELECT msg_id, CASE WHEN cid IS NOT NULL THEN CAST(cid AS VARCHAR) ELSE sha256('provisional:' || h) END AS customer_id,
           CASE WHEN cid IS NOT NULL AND NOT prov THEN 1.0 WHEN cid IS NULL AND n = 1 THEN 0.5 ELSE 0.6 END::DOUBLE AS match_confidence,
           CASE WHEN cid IS NOT NULL AND NOT prov THEN 'phone_exact' WHEN cid IS NULL AND n = 1 THEN 'auto_created_provisional' ELSE 'phone_provisional' END AS match_method,
           CASE WHEN cid IS NOT NULL AND NOT prov THEN 'probable' ELSE 'provisional' END AS link_status
    FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY timestamp, msg_id) AS n FROM unlinked)"""


def _new_links(t: Tables):
    chats = t.chats().withColumn("phone_number", T.hash_phone(F.col("phone")))
    return B.link_messages(chats, known_customers(t), chats.filter("direction = 'outbound'"))


@query("link_messages", _LINKED, "unlinked")
def _(t):
    return _new_links(t).select("msg_id", "customer_id", "match_confidence", "match_method", "link_status")


@query("provisional_customers", """
    SELECT sha256('provisional:' || h) AS customer_id, h AS phone_hash, '[Provisional] ' || substr(h, 1, 8) || '...' AS name, false AS consent_given, true AS is_provisional
    FROM unlinked WHERE cid IS NULL GROUP BY h""", "unlinked")
def _(t):
    return B.provisional_customers(_new_links(t))


@query("linking_stats", """
    SELECT (SELECT count(*) FROM events) AS total_raw, count(*) AS total_linked, (SELECT count(*) FROM events) - count(*) AS unlinked, count(*) FILTER (match_confidence >= 0.9) AS high_confidence,
           count(*) FILTER (match_confidence >= 0.7 AND match_confidence < 0.9) AS medium_confidence, count(*) FILTER (match_confidence < 0.7) AS low_confidence FROM links""", "links")
def _(t):
    return B.linking_stats(t.read("events"), t.links())


for _name, _statuses in (("trusted_feedback_ml", "('verified')"), ("trusted_feedback_dashboard", "('verified', 'probable')")):
    @query(_name, f"""
        SELECT m.msg_id, m.phone_number, m.text, m.timestamp, m.direction, l.link_id, l.customer_id, l.match_confidence, l.link_status, f.feature_id, f.msg_length, f.processed_at
        FROM messages m JOIN links l ON l.msg_id = m.msg_id LEFT JOIN message_features f ON f.link_id = l.link_id AND f.has_complaint WHERE l.link_status IN {_statuses}""", "messages links message_features")
    def _(t, name=_name):
        return getattr(B, name)(t.messages(), t.links(), t.message_features().filter("has_complaint"))


@query("real_customers", "SELECT * FROM customers WHERE is_provisional IS NULL OR NOT is_provisional", "customers")
def _(t):
    return B.real_customers(t.customers())


def vector_tables(t: Tables):
    e = t.read("embeddings")
    status = F.when(F.col("vec_id") % 3 == 0, "verified").when(F.col("vec_id") % 3 == 1, "probable").otherwise("rejected")
    links = e.select(F.col("vec_id").alias("link_id"), F.col("label").alias("customer_id"), status.alias("link_status"))
    version = F.when(F.col("vec_id") % 5 == 0, "v1").when(F.col("vec_id") % 5 < 4, "v2")
    feats = e.select(F.col("vec_id").alias("link_id"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"), version.alias("embedding_model_version"),
                     F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(vec_id AS INT), 0)").alias("processed_at"))
    registry = t.read("region").select(F.concat(F.lit("v"), "r_regionkey").alias("model_version"), (F.col("r_regionkey") == 2).alias("is_active"))
    return links, feats, registry


add_cte("vectors", "", """
    SELECT vec_id AS link_id, label AS customer_id, CASE vec_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'probable' ELSE 'rejected' END AS link_status,
           CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding, CASE WHEN vec_id % 5 = 0 THEN 'v1' WHEN vec_id % 5 < 4 THEN 'v2' END AS version FROM embeddings""")


@query("trusted_semantic_embeddings", """
    SELECT customer_id, link_id, link_status, version AS embedding_model_version, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM vectors
    WHERE link_status = 'verified' AND embedding IS NOT NULL AND (version IS NULL OR version = (SELECT 'v' || r_regionkey FROM region WHERE r_regionkey = 2))""", "vectors")
def _(t):
    links, feats, registry = vector_tables(t)
    out = B.semantic_embeddings(links, feats, ("verified",), registry)
    return out.select("customer_id", "link_id", "link_status", "embedding_model_version", r6(F.col("embedding")[0].cast("double")).alias("first_value"))


@query("dashboard_semantic_embeddings", "SELECT customer_id, link_id, link_status, version AS embedding_model_version FROM vectors WHERE link_status IN ('verified', 'probable') AND embedding IS NOT NULL", "vectors")
def _(t):
    links, feats, _ = vector_tables(t)
    return B.semantic_embeddings(links, feats, ("verified", "probable")).drop("embedding", "processed_at")


@query("relabel_link_status", """
    SELECT link_id, CASE WHEN link_status = 'provisional' THEN CASE WHEN match_confidence >= 0.7 THEN 'probable' ELSE 'provisional' END ELSE link_status END AS link_status
    FROM (SELECT link_id, (link_id % 100) / 100.0 AS match_confidence, link_status FROM links)""", "links")
def _(t):
    return B.relabel_link_status(t.links().withColumn("match_confidence", (F.col("link_id") % 100) / 100.0)).select("link_id", "link_status")


@query("flag_provisional_names", "SELECT customer_id, coalesce(is_provisional, false) OR city IN ('BUILDING', 'MACHINERY') AS is_provisional FROM customers", "customers")
def _(t):
    name = F.when(F.col("city") == "BUILDING", F.concat(F.lit("Customer_"), F.col("customer_id").cast("string"))).when(F.col("city") == "MACHINERY", F.lit("[Provisional] 62")).otherwise(F.col("name"))
    return B.flag_provisional_names(t.customers().withColumn("name", name)).select("customer_id", "is_provisional")


@query("backfill_links", """
    SELECT f.feature_id, f.msg_id, CASE WHEN l.link_id IS NOT NULL THEN CAST(l.link_id AS VARCHAR) ELSE sha256('link:' || f.msg_id) END AS link_id
    FROM message_features f LEFT JOIN links l ON l.msg_id = f.msg_id AND l.link_status = 'verified'""", "message_features links")
def _(t):
    return B.backfill_links(t.message_features(), t.links().filter("link_status = 'verified'")).select("feature_id", "msg_id", "link_id")


@query("backfill_phones", """
    SELECT m.msg_id, coalesce(k.phone_hash, 'unknown') AS phone_number FROM messages m
    LEFT JOIN known k ON k.customer_id = CAST(m.phone_number AS BIGINT) AND k.is_provisional""", "messages known")
def _(t):
    m = t.messages().withColumn("customer_id", F.col("phone_number").cast("bigint")).withColumn("phone_number", F.lit(None).cast("string"))
    return B.backfill_phones(m, known_customers(t).filter("is_provisional")).select("msg_id", "phone_number")


@query("split_legacy_features", """
    SELECT s.customer_id, s.as_of_date, round(s.avg_sentiment_score, 6) + 0.0 AS avg_sentiment_score FROM semantics s
    WHERE s.avg_sentiment_score IS NOT NULL AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.customer_id = s.customer_id AND p.as_of_date = s.as_of_date AND p.churn_label = 'high')""", "semantics predictions")
def _(t):
    taken = t.predictions().filter("churn_label = 'high'")
    out = B.split_legacy(t.semantics(), taken, ("avg_sentiment_score",), ("avg_sentiment_score",))
    return out.withColumn("avg_sentiment_score", r6("avg_sentiment_score"))


@query("integrity_report", """
    SELECT 'feature_link_customer_mismatch' AS rule, count(*) AS violations FROM links WHERE customer_id % 10 = 3
    UNION ALL SELECT 'feature_without_link', 0 UNION ALL SELECT 'confidence_out_of_range', count(*) FROM links WHERE match_confidence * 1.5 > 1
    UNION ALL SELECT 'unknown_link_status', 0 UNION ALL SELECT 'repeated_link_message', 0 UNION ALL SELECT 'repeated_feature_link', 0
    UNION ALL SELECT 'link_without_message', count(*) FROM links JOIN messages USING (msg_id) WHERE direction <> 'inbound'
    UNION ALL SELECT 'link_without_customer', count(*) FROM links WHERE customer_id NOT IN (SELECT customer_id FROM customers WHERE is_active)""", "links messages customers")
def _(t):
    feats = t.message_features().withColumn("customer_id", F.when(F.col("customer_id") % 10 == 3, F.col("customer_id") + 1).otherwise(F.col("customer_id")))
    links = t.links().withColumn("match_confidence", F.col("match_confidence") * 1.5)
    return B.integrity_report(links, feats, t.messages().filter("direction = 'inbound'"), t.customers().filter("is_active"))


@query("erase_customers", """
    SELECT 'transactions' AS tbl, count(*) AS rows FROM transactions WHERE customer_id NOT IN (SELECT customer_id FROM customers WHERE is_provisional)
    UNION ALL SELECT 'predictions', count(*) FROM predictions WHERE customer_id NOT IN (SELECT customer_id FROM customers WHERE is_provisional)
    UNION ALL SELECT 'actions_unlinked', count(*) FROM actions WHERE action_id NOT IN (SELECT pred_id FROM predictions WHERE customer_id NOT IN (SELECT customer_id FROM customers WHERE is_provisional))""", "transactions predictions actions customers")
def _(t):
    kept = B.erase_customers({"transactions": t.transactions(), "predictions": t.predictions()}, t.customers().filter("is_provisional"))
    loose = B.unlink_erased_predictions(t.actions().withColumn("pred_id", F.col("action_id")), kept["predictions"]).filter("pred_id IS NULL")
    out = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("tbl"), "rows") for n, df in [*kept.items(), ("actions_unlinked", loose)]]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("mask_fields", """
    SELECT customer_id, substr(phone, 1, 4) || '****' || right(phone, 4) AS masked, substr(sha256(phone), 1, 8) || '***' AS prefix,
           CASE WHEN length(name || ' of ' || city) > 20 THEN substr(name || ' of ' || city, 1, 20) || '...' ELSE name || ' of ' || city END AS snippet FROM customers""", "customers")
def _(t):
    return t.customers().select("customer_id", T.mask_phone(F.col("phone")).alias("masked"), T.mask_phone_prefix(F.sha2("phone", 256)).alias("prefix"),
                                T.truncate(F.concat("name", F.lit(" of "), "city"), 20).alias("snippet"))


# ---------------------------------------------------------------------------------------------
# C: messages
# ---------------------------------------------------------------------------------------------
@query("message_stats", "SELECT msg_id, length(coalesce(text, '')) AS msg_length, length(text) - length(replace(text, '!', '')) AS num_exclamations, length(text) - length(replace(text, '?', '')) AS num_questions FROM texts", "texts")
def _(t):
    return t.texts().select("msg_id", *[c.alias(n) for n, c in T.message_stats(F.col("text")).items()])


def _sql_rule(patterns: tuple[str, ...], column: str = "text") -> str:
    space = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
    body = "|".join(p.replace(r"\b", "").replace(r"\s", space).replace(" ", space + "+") for p in patterns)
    return rf"regexp_matches(lower({column}), '(^|[^\p{{L}}\p{{N}}_])({body})($|[^\p{{L}}\p{{N}}_])')"


@query("detect_complaint", f"""
    SELECT doc_id, {_sql_rule(T.COMPLAINT_PATTERNS + T.REFUND_PATTERNS)} AS default_rules, {_sql_rule(COMMON_COMPLAINT + COMMON_REFUND)} AS common_rules FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", T.detect_complaint(F.col("text")).alias("default_rules"), T.detect_complaint(F.col("text"), COMMON_COMPLAINT, COMMON_REFUND).alias("common_rules"))


@query("detect_refund", f"SELECT doc_id, {_sql_rule(T.REFUND_PATTERNS)} AS default_rules, {_sql_rule(COMMON_REFUND)} AS common_rules FROM documents")
def _(t):
    return t.read("documents").select("doc_id", T.detect_refund(F.col("text")).alias("default_rules"), T.detect_refund(F.col("text"), COMMON_REFUND).alias("common_rules"))


_C4 = f"""
    SELECT l.link_id, l.msg_id, length(c.text) AS msg_length, {_sql_rule(COMMON_COMPLAINT + COMMON_REFUND, 'c.text')} AS has_complaint, {_sql_rule(COMMON_REFUND, 'c.text')} AS has_refund_request
    FROM chats c JOIN (SELECT msg_id, msg_id * 10 AS link_id, CASE WHEN customer_id % 4 = 0 THEN 0.6 ELSE 1.0 END AS conf FROM chats) l USING (msg_id) WHERE l.conf >= 0.7 AND c.direction = 'inbound'"""


def _chat_links(t: Tables):
    return t.chats().select("msg_id", (F.col("msg_id") * 10).alias("link_id"), "customer_id", F.when(F.col("customer_id") % 4 == 0, 0.6).otherwise(1.0).alias("match_confidence"))


def _chat_features(t: Tables, refresh: bool = False):
    done = t.chats().filter("direction = 'outbound'").select((F.col("msg_id") * 10).alias("link_id"))
    return C.extract_message_features(t.chats(), _chat_links(t), done, refresh, complaint=COMMON_COMPLAINT, refund=COMMON_REFUND)


@query("extract_message_features", _C4, "chats")
def _(t):
    return _chat_features(t).select("link_id", "msg_id", "msg_length", "has_complaint", "has_refund_request")


@query("extraction_stats", "SELECT count(*) AS processed, count(*) FILTER (direction = 'outbound') AS refreshed FROM chats WHERE customer_id % 4 <> 0", "chats")
def _(t):
    return C.extraction_stats(_chat_features(t, refresh=True))


_C5 = """
    SELECT m.msg_id, m.customer_id, m.timestamp, r.replied_at, CAST(floor((epoch_us(r.replied_at) - epoch_us(m.timestamp)) / 1000000) AS BIGINT) AS response_time_secs FROM {src} m
    LEFT JOIN (SELECT a.msg_id, arg_min(b.timestamp, (b.timestamp, b.msg_id)) AS replied_at FROM {src} a JOIN {src} b ON b.customer_id = a.customer_id AND b.direction = 'outbound'
               AND (b.timestamp > a.timestamp OR (b.timestamp = a.timestamp AND b.msg_id > a.msg_id)) WHERE a.direction = 'inbound' GROUP BY 1) r USING (msg_id)
    WHERE m.direction = 'inbound'"""
add_cte("talk", "messages", "SELECT msg_id, CAST(phone_number AS BIGINT) AS customer_id, timestamp, direction FROM messages")


@query("response_times", _C5.format(src="talk"), "talk")
def _(t):
    return C.response_times(t.messages().select("msg_id", F.col("phone_number").cast("bigint").alias("customer_id"), "timestamp", "direction"))


@query("response_times_chat", _C5.format(src="chats"), "chats")
def _(t):
    return C.response_times(t.chats().drop("text", "phone"))


@query("embed_messages_checked", "SELECT msg_id, length(trim(text)) > 0 AS has_vector, CASE WHEN length(trim(text)) > 0 THEN 64 END AS dims, CASE WHEN length(trim(text)) > 0 THEN 1.0::DOUBLE END AS norm FROM texts", "texts")
def _(t):
    """What must hold for any encoder of unit vectors: a vector exactly for texts that are not blank, of length one."""
    v = F.col("embedding")
    out = C.embed_messages(t.texts())
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("msg_id", v.isNotNull().alias("has_vector"), F.when(v.isNotNull(), F.size(v)).alias("dims"), F.round(length, 4).alias("norm"))


@query("embed_messages")
def _(t):
    return C.embed_messages(t.texts())


@query("mean_embedding", """
    SELECT v.customer_id, v.pos, round(m.mean, 6) + 0.0 AS value, c.n AS embedding_count FROM (SELECT DISTINCT customer_id, unnest(generate_series(1, 64)) AS pos FROM vectors) v
    JOIN (SELECT customer_id, count(embedding) AS n FROM vectors GROUP BY 1) c USING (customer_id)
    JOIN (SELECT customer_id, pos, avg(CAST(x AS DOUBLE)) AS mean FROM (SELECT customer_id, unnest(embedding) AS x, unnest(generate_series(1, 64)) AS pos FROM vectors WHERE embedding IS NOT NULL) GROUP BY 1, 2) m USING (customer_id, pos)""", "vectors")
def _(t):
    links, feats, _ = vector_tables(t)
    means = C.mean_embedding(feats.join(links, "link_id"))
    return means.select("customer_id", "embedding_count", F.posexplode("avg_embedding").alias("p", "x")).select("customer_id", (F.col("p") + 1).alias("pos"), r6("x").alias("value"), "embedding_count")


@query("mean_embedding_versioned", """
    SELECT customer_id, count(*) AS vectors, min(v) AS version_low, max(v) AS version_high FROM (SELECT customer_id, embedding, CASE WHEN customer_id % 2 = 0 THEN version ELSE 'v2' END AS v FROM vectors)
    WHERE embedding IS NOT NULL GROUP BY 1 HAVING min(v) <> max(v)""", "vectors")
def _(t):
    links, feats, _ = vector_tables(t)
    rows = feats.join(links, "link_id").withColumn("embedding_model_version", F.when(F.col("customer_id") % 2 == 0, F.col("embedding_model_version")).otherwise("v2"))
    return C.mean_embedding_versioned(rows)[1]


@query("cosine_similarity", """
    SELECT a.vec_id, CASE WHEN a.vec_id % 11 = 0 THEN NULL ELSE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) END AS cosine,
           CASE WHEN a.vec_id % 11 = 0 THEN 'zero_vector' END AS reason
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    e = t.read("embeddings")
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    a = e.select("vec_id", F.when(F.col("vec_id") % 11 == 0, zero).otherwise(F.col("embedding")).alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", r6(V.cosine(F.col("a"), F.col("b"))).alias("cosine"), V.cosine_reason(F.col("a"), F.col("b")).alias("reason"))


@query("normalize_text", f"SELECT doc_id, sha256({_NORM}) AS clean_hash, length({_NORM}) AS clean_length FROM documents")
def _(t):
    clean = T.normalize_text(F.col("text"))
    return t.read("documents").select("doc_id", F.sha2(clean, 256).alias("clean_hash"), F.length(clean).alias("clean_length"))


@query("trainable_filter", f"SELECT msg_id FROM texts WHERE length({_NORM}) >= 100 AND lower({_NORM}) NOT IN {_FILLER}", "texts")
def _(t):
    return t.texts().filter(T.is_trainable(F.col("text"), 100)).select("msg_id")
