"""Erasing customers from stored tables: tombstones, rewritten partitions, one commit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources import catalog

TOMBSTONES = "tombstones"
CID = "customer_id"


def tombstones(spark: SparkSession, root: str) -> DataFrame:
    """Customers erased so far (customer_id, erased_at)."""
    _, content = catalog.read_catalog(spark, root)
    if TOMBSTONES not in content:
        return spark.createDataFrame([], "customer_id string, erased_at timestamp_ntz")
    return catalog.table(spark, content, TOMBSTONES).drop("_part")


def without_erased(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Rows of an import without those of customers erased before: what is gone does not come back."""
    gone = tombstones(spark, root).select(F.col(CID).alias("_gone"))
    return rows.join(gone, F.col(CID).cast("string") == F.col("_gone"), "left_anti")


def erase_stored(spark: SparkSession, root: str, erase: DataFrame, now: dt.datetime, references: dict[str, tuple[str, str]] | None = None) -> int:
    """Remove customers from all stored tables below ``root`` and return the number of tables rewritten.

    A table that has customer_id loses their rows, in the partitions that hold any; the other partitions keep their files. ``references``
    names tables whose rows stay but lose a reference to what is gone: table -> (column, table of the same column). All
    changes and the tombstones become visible by one rename: a run that dies leaves the old tables, and can be run again;
    a second run for the same customers finds nothing to do. Null ids are no customers.
    """
    base, content = catalog.read_catalog(spark, root)
    ids = erase.filter(F.col(CID).isNotNull()).select(F.col(CID).cast("string").alias("_gone")).distinct()
    before, changed = content, 0
    for name in sorted(content):
        if name == TOMBSTONES or CID not in catalog.table(spark, content, name).columns:
            continue
        mine = catalog.table(spark, content, name)
        hit = mine.select(F.col(CID).cast("string").alias("_gone"), "_part").join(ids, "_gone", "left_semi")
        content = catalog.rewritten(spark, root, content, name, hit, lambda rows: rows.join(ids, F.col(CID).cast("string") == F.col("_gone"), "left_anti"))
    for name, (column, target) in sorted((references or {}).items()):
        lost = catalog.table(spark, before, target).select(column).join(catalog.table(spark, content, target).select(column), column, "left_anti").distinct()
        hit = catalog.table(spark, content, name).select(column, "_part").join(lost, column, "left_semi")

        def cut(rows: DataFrame, column: str = column, lost: DataFrame = lost) -> DataFrame:
            marked = rows.join(lost.withColumn("_lost", F.lit(True)), column, "left")
            return marked.withColumn(column, F.when(F.col("_lost").isNull(), F.col(column))).drop("_lost").select(*rows.columns)

        content = catalog.rewritten(spark, root, content, name, hit, cut)
    changed = sum(content[n] != before[n] for n in before)
    known = tombstones(spark, root)
    new = ids.select(F.col("_gone").alias(CID), F.lit(now).cast("timestamp_ntz").alias("erased_at")).join(known.select(CID), CID, "left_anti")
    if new.isEmpty() and not changed:
        return 0
    parts = catalog._write(spark, root, TOMBSTONES, known.unionByName(new).withColumn("_part", F.lit("all")))
    content = content | {TOMBSTONES: {"schema": known.schema.json(), "column": None, "parts": parts}}
    catalog.publish(spark, root, base, content)
    return changed
