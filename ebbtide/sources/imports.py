"""Reading import CSV files and storing snapshot tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import shared_folder
from ebbtide.sources.csv_records import read_quoted_csv


def plain_name(header: str) -> str:
    """A header cell as a column name: no byte-order mark, lower case, runs of blanks as one underscore."""
    return re.sub(r"[\s_]+", "_", re.sub(r"^[\ufeff\s]+|\s+$", "", header).lower())


def read_import_csv(spark: SparkSession, path: str, multi_line: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """A1: every column as text, blank cells NULL, headers trimmed, lower case, blanks to underscores.

    Spark splits large files over tasks. ``multi_line`` allows line breaks inside quoted cells, as in message files; such
    files are split as well (``csv_records``). Files of one path must have one header: a file
    with its columns in another order is refused, never read by position. Files in another encoding than UTF-8 need
    ``encoding``; with line breaks in cells they are read one file per task, for bytes in the middle of such a file cannot be told apart.
    """
    if multi_line and encoding.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        heads, rows = read_quoted_csv(spark, path)
        cells = [F.nullif(F.col("cells")[k], F.lit("")).alias(f"c{k}") for k in range(len(heads))]
        return rows.select(*cells, "source_file", "source_row").toDF(*[plain_name(h) for h in heads], "source_file", "source_row")
    raw = (
        spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .option("encoding", encoding).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    )
    names = [plain_name(c) for c in raw.columns]
    cells = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns]  # quoted blanks are blank cells too
    meta = raw.select(*cells, F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("source_row"))
    return meta.toDF(*names, "source_file", "source_row")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate files that driver and executors share."""
    return shared_folder(spark, label)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None where nothing is there; an unreadable table is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path)


def write_snapshot(rows: DataFrame, path: str, keys: tuple[str, ...] = ("customer_id",), partition: str = "as_of_date", files: int = 64) -> None:
    """Upsert by key and date: only the touched date partitions are read, merged and replaced.

    Each date is written as ``files`` files, by as many tasks. Of several rows of one key and date the one with the
    least other columns, in their order, is kept. The merged rows are staged first, so a lost executor never reads a
    half-replaced partition.
    """
    others = [c for c in rows.columns if c not in (*keys, partition)]
    rows = rows.groupBy(*keys, partition).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, partition, "_r.*").select(*rows.columns) if others else rows.distinct()
    spark = rows.sparkSession
    old = stored(spark, path)
    if old is not None:
        touched = [r[0] for r in rows.select(partition).distinct().collect()]  # one value per as-of date
        kept = old.filter(F.col(partition).isin(touched)).join(rows.select(*keys, partition), [*keys, partition], "left_anti")
        staged = scratch_dir(spark, "stage")
        kept.unionByName(rows, allowMissingColumns=True).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
    (
        rows.repartition(partition, F.pmod(F.xxhash64(*keys), F.lit(files)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )
