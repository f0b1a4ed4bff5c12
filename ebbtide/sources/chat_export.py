"""Chat export text: ``[day/month/year, time] sender: text`` lines with continuation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.functions.text import SPACE_CLASS, strip_space

# Lines the exporting app writes for attachments and the encryption notice.
SYSTEM_MARKERS = ("<Media omitted>", "Messages and calls are end-to-end encrypted")

HEADER = (
    r"(?d)^\[([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4})," + SPACE_CLASS + r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\]"
    + SPACE_CLASS + r"([^:]+):" + SPACE_CLASS + r"(.+)"
)


def read_export_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, input split and position; big files are read by many tasks."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def parse_chat_export(lines: DataFrame, business_name: str = "Admin") -> DataFrame:
    """Messages from lines (file, block, line_no, line).

    A continuation line belongs to the last header above it. The last header is carried in two
    steps, inside a block and from block to block, so that one huge file is no single task. A
    header with an impossible date is dropped and what follows it joins the message before.
    """
    def part(i: int):
        return F.regexp_extract("line", HEADER, i)

    year = part(3)
    full_year = (
        F.when(F.length(year) == 4, year.try_cast("int"))
        .when(F.length(year) == 2, year.try_cast("int") + F.when(year >= "69", 1900).otherwise(2000))
    )
    at = F.try_make_timestamp_ntz(
        full_year, part(2).try_cast("int"), part(1).try_cast("int"), part(4).try_cast("int"), part(5).try_cast("int"),
        F.coalesce(F.nullif(part(6), F.lit("")), F.lit("0")).try_cast("int"),
    )
    wanted = F.length(strip_space(F.col("line"))) > 0
    for marker in SYSTEM_MARKERS:
        wanted = wanted & ~F.col("line").contains(marker)
    is_header = F.col("line").rlike(HEADER)
    tagged = (
        lines.filter(wanted)
        .withColumn("_ts", F.when(is_header, at))
        .filter(~is_header | F.col("_ts").isNotNull())
        .withColumn("_start", F.when(F.col("_ts").isNotNull(), F.struct("block", "line_no")))
    )
    inside = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tagged.groupBy("file", "block").agg(F.max("_start").alias("_s")).select(
        "file", "block", F.last("_s", ignorenulls=True).over(before).alias("_carry")
    )
    owned = (
        tagged.withColumn("_own", F.last("_start", ignorenulls=True).over(inside))
        .join(carried, ["file", "block"])
        .withColumn("_message", F.coalesce("_own", "_carry"))
        .filter(F.col("_message").isNotNull())
    )
    body = strip_space(F.when(F.col("_ts").isNotNull(), part(8)).otherwise(F.col("line")))
    sender = F.when(F.col("_ts").isNotNull(), strip_space(part(7)))
    pieces = owned.groupBy("file", F.col("_message.block").alias("message_block"), F.col("_message.line_no").alias("message_line")).agg(
        F.max("_ts").alias("timestamp"),
        F.max(sender).alias("sender"),
        F.array_sort(F.collect_list(F.struct("block", "line_no", body.alias("body")))).alias("_parts"),
    )
    direction = F.when(F.lower("sender").contains(business_name.lower()), "outbound").otherwise("inbound")
    return pieces.select(
        "file", "message_block", "message_line", "sender", "timestamp", direction.alias("direction"),
        F.array_join(F.transform("_parts", lambda p: p["body"]), "\n").alias("text"),
    )
