"""Streams whose triggers come out of order, with late and retried rows."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import messages
from ebbtide.streaming import jobs

AT = dt.datetime(2024, 3, 1)
TALK = "msg_id long, customer_id long, direction string, timestamp timestamp_ntz"
#: A message far ahead that moves the watermark past all others.
BEAT = [(10**9, -1, "inbound", AT + dt.timedelta(days=90))]


def said(n, seed, hot=0.0):
    rng = random.Random(seed)
    return [
        (i, 0 if rng.random() < hot else rng.randrange(1, 9), rng.choice(["inbound", "inbound", "outbound"]), AT + dt.timedelta(seconds=rng.choice([rng.randrange(86_400 * 2), rng.randrange(24) * 3600]), microseconds=rng.choice([0, 0, 500_000])))
        for i in range(n)
    ]


def feed(spark, folder, triggers, schema):
    for rows in triggers:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def replies(spark, tmp_path, triggers, delay="30 days"):
    stream = feed(spark, str(tmp_path / "in"), triggers, TALK)
    out = jobs.run_available(jobs.stream_response_times(stream, delay, 7), str(tmp_path / "out"), str(tmp_path / "ck"))
    return sorted(map(tuple, out.select("customer_id", "msg_id", "response_time_secs").collect()))


def batch(spark, rows):
    want = messages.response_times(spark.createDataFrame(rows, TALK)).filter("response_time_secs IS NOT NULL")
    return sorted(map(tuple, want.select("customer_id", "msg_id", "response_time_secs").collect()))


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_shuffled_triggers_give_the_replies_of_the_batch(spark, tmp_path, hot):
    rows = said(240, 4, hot)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    triggers = [mixed[k::4] for k in range(4)] + [BEAT]
    want = batch(spark, rows)
    assert len(want) > 50 and replies(spark, tmp_path, triggers) == want


def test_waiting_over_hours_and_triggers_in_order(spark, tmp_path):
    """The watermark moves on between triggers; messages wait in the parts until a later hour answers them."""
    rows = [(i, 1, "inbound", AT + dt.timedelta(hours=i, minutes=5)) for i in range(30)] + [(100, 1, "outbound", AT + dt.timedelta(hours=30)), (101, 1, "inbound", AT + dt.timedelta(hours=30, minutes=1))]
    triggers = [rows[k : k + 8] for k in range(0, 32, 8)] + [BEAT]
    assert replies(spark, tmp_path, triggers, "1 hour") == batch(spark, rows)


def test_what_waits_too_long_is_given_up(spark, tmp_path):
    rows = [(1, 1, "inbound", AT), (2, 1, "inbound", AT + dt.timedelta(days=9))]
    reply = (3, 1, "outbound", AT + dt.timedelta(days=12))
    far = [(10**9 - 1, -1, "inbound", AT + dt.timedelta(days=10))]
    assert replies(spark, tmp_path, [rows, far, [reply], BEAT], "1 hour") == [(1, 2, 3 * 86_400)]


def test_many_customers_share_few_states(spark, tmp_path):
    """The number of states is set by the hours: customers of an hour are in GROUPS groups, and each is answered by its own replies."""
    rng = random.Random(7)
    rows = [(i, rng.randrange(150), rng.choice(["inbound", "outbound"]), AT + dt.timedelta(seconds=rng.randrange(4 * 3600), microseconds=rng.choice([0, 999_999]))) for i in range(600)]
    stream = feed(spark, str(tmp_path / "plan"), [rows], TALK)
    plan = jobs.stream_response_times(stream, "1 hour")._jdf.queryExecution().analyzed().toString()
    keys = [line.split("transformWithStateUDF(")[1].split(",")[:2] for line in plan.split("\n") if "transformWithStateUDF(" in line]
    assert [[k.strip().split("#")[0] for k in pair] for pair in keys] == [["grp", "part"], ["grp", "hour"]]
    assert replies(spark, tmp_path, [rows, BEAT]) == batch(spark, rows)


def test_retried_messages_with_another_time_fall_once(spark, tmp_path):
    schema = "msg_id long, phone_number string, timestamp timestamp_ntz, text string"
    first = [(i, "08", AT + dt.timedelta(minutes=i), f"t{i}") for i in range(10)]
    again = [(i, "08", AT + dt.timedelta(minutes=i, seconds=30), f"t{i}") for i in range(0, 10, 2)]
    stream = feed(spark, str(tmp_path / "in"), [first, again], schema)
    out = jobs.run_available(jobs.stream_ingest_messages(stream, "1 day", retried=("msg_id",)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["msg_id"] for r in out.collect()) == list(range(10))


def test_late_rows_are_counted_and_stored(spark, tmp_path):
    schema = "customer_id long, timestamp timestamp_ntz"
    early = [(1, AT), (2, AT + dt.timedelta(days=5))]
    late = [(3, AT + dt.timedelta(hours=1)), (4, AT + dt.timedelta(hours=2)), (5, AT + dt.timedelta(days=5))]
    listener = jobs.LateRows(spark, str(tmp_path / "late"))
    spark.streams.addListener(listener)
    try:
        stream = feed(spark, str(tmp_path / "in"), [early, [(2, AT + dt.timedelta(days=6))], late, [(9, AT + dt.timedelta(days=20))]], schema)
        out = jobs.run_available(jobs.stream_message_counts(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
        for _ in range(100):  # progress is told after the trigger
            found = jobs.late_rows(spark, str(tmp_path / "late")).agg(F.sum("late_rows")).first()[0]
            if found:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert found == 2
    assert sorted((r["customer_id"], r["messages"]) for r in out.collect()) == [(1, 1), (2, 1), (2, 1), (5, 1)]
    assert jobs.late_rows(spark, str(tmp_path / "none")).count() == 0
