"""Snapshot tables stored in buckets of a key, so that tables of one date join without a shuffle."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.sources import catalog


def _registered(spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The files of a folder as a table that Spark knows the buckets of. The session's catalog holds its name only; the files are elsewhere."""
    name = f"bucketed_{hashlib.md5(folder.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def write_bucketed(spark: SparkSession, root: str, tables: dict[str, DataFrame], date: str, key: str = "customer_id", buckets: int = 64) -> None:
    """Upsert the rows of several tables for one date, by ``key``, in one commit.

    A table of a date is one folder of ``buckets`` files, each sorted by the key; rows of keys that are not given are kept. All tables must
    have the same number of buckets to join without a shuffle; a date stored with another number is dealt anew.
    """
    base, content = catalog.read_catalog(spark, root)
    for name, rows in tables.items():
        known = content.get(f"bucketed:{name}", {})
        old = known.get(date)
        if old is not None:
            before = _registered(spark, old["folder"], T.StructType.fromJson(old["schema"]), key, old["buckets"])
            rows = before.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
        folder, temp = f"{root}/data/{name}/{uuid.uuid4().hex}", f"writing_{uuid.uuid4().hex}"
        rows = rows.repartition(buckets, key)
        rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(temp)
        schema = spark.table(temp).schema
        spark.sql(f"DROP TABLE {temp}")  # the name goes, files of a given path stay
        content = content | {f"bucketed:{name}": known | {date: {"folder": folder, "buckets": buckets, "schema": schema.jsonValue()}}}
    catalog.publish(spark, root, base, content)


def read_bucketed(spark: SparkSession, root: str, name: str, date: str, key: str = "customer_id") -> DataFrame:
    """A table of a date, with its buckets."""
    one = catalog.read_catalog(spark, root)[1][f"bucketed:{name}"][date]
    return _registered(spark, one["folder"], T.StructType.fromJson(one["schema"]), key, one["buckets"])


def joined(spark: SparkSession, root: str, names: list[str], date: str, key: str = "customer_id") -> DataFrame:
    """The first table with the others joined to it by the key; where all have the same buckets, nothing is shuffled."""
    _, content = catalog.read_catalog(spark, root)
    out = None
    for name in names:
        one = content[f"bucketed:{name}"][date]
        rows = _registered(spark, one["folder"], T.StructType.fromJson(one["schema"]), key, one["buckets"])
        # without a hint a small table would be broadcast, which is well as long as it stays small; buckets do not ask
        out = rows if out is None else out.join(rows.hint("merge"), key, "left")
    return out if out is not None else spark.createDataFrame([], T.StructType()).select(F.lit(None))
