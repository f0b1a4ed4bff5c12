"""Several stored tables that change together: partition folders listed in one catalog, which is replaced by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partition of rows whose partition value is missing.
NONE = "__none__"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/catalog")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def read_catalog(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest catalog; 0 and nothing where there is none. Content: table -> columns and folder of each partition."""
    versions = _versions(spark, root)
    if not versions:
        return 0, {}
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{root}/catalog/{versions[-1]:012d}.json").collect())  # a line per partition
    return versions[-1], json.loads(text)


def publish(spark: SparkSession, root: str, base: int, content: dict) -> None:
    """Make ``content`` the catalog after number ``base``: written beside it, then renamed. It is refused if another run was first.

    Until the rename readers see the old folders of all tables, after it the new ones; a run that is killed before
    leaves files that no catalog names. The file system must rename in one step, as HDFS and local ones do.
    """
    temp = f"{root}/catalog/.{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(temp)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, False)
    try:
        out.write(bytearray(json.dumps(content, indent=0), "utf-8"))
    finally:
        out.close()
    context, goal = _files(spark, f"{root}/catalog/{base + 1:012d}.json")
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(path, goal, none)  # fails where the goal exists


def _write(spark: SparkSession, root: str, name: str, rows: DataFrame) -> dict[str, str]:
    """Write rows with a ``_part`` column to a fresh folder; folder of each partition."""
    folder = f"{root}/data/{name}/{uuid.uuid4().hex}"
    rows.repartition("_part", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "_part"]), F.lit(8))).write.partitionBy("_part").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in listed if s.isDirectory()]
    return {spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(n.removeprefix("_part=")): f"{folder}/{n}" for n in names}


def _part(column: str | None):
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE)) if column else F.lit("all")


def put_tables(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, str | None]]) -> None:
    """Store tables, each with the column that its folders go by (None: one folder), in one commit. Tables of other names stay."""
    base, content = read_catalog(spark, root)
    for name, (rows, column) in tables.items():
        parts = _write(spark, root, name, rows.withColumn("_part", _part(column)))
        content = content | {name: {"schema": rows.schema.json(), "column": column, "parts": parts}}
    publish(spark, root, base, content)


def table(spark: SparkSession, content: dict, name: str) -> DataFrame:
    """A table as the catalog has it, with the folder's partition in ``_part``."""
    known = content[name]
    schema = T.StructType.fromJson(json.loads(known["schema"]))
    out = None
    by_folder: dict[str, list[str]] = {}
    for path in known["parts"].values():
        by_folder.setdefault(path.rsplit("/", 1)[0], []).append(path)
    for folder, paths in by_folder.items():  # one scan per commit that touched the table
        one = spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.StringType())])).option("basePath", folder).parquet(*paths)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema).withColumn("_part", F.lit(None).cast("string"))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, read_catalog(spark, root)[1], name).drop("_part")


def rewritten(spark: SparkSession, root: str, content: dict, name: str, touched: DataFrame, change) -> dict:
    """``content`` with the partitions of ``name`` that ``touched`` (a ``_part`` column) lists replaced by ``change`` of their rows; others keep their folders."""
    parts = [r[0] for r in touched.select("_part").distinct().collect()]  # partitions of one table
    if not parts:
        return content
    rows = table(spark, content, name).filter(F.col("_part").isin(parts))
    new = _write(spark, root, name, change(rows))
    kept = {k: v for k, v in content[name]["parts"].items() if k not in parts}
    return content | {name: content[name] | {"parts": kept | new}}
