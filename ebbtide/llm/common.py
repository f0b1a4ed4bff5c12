"""Helpers shared by the corpus operators: stored stages, row ids, size checks."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import shared_folder

#: Rows up to which a side may be broadcast; every use states how many bytes a row has.
BROADCAST_ROWS = 200_000


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs the tasks it ran, not the chain that led to them. The files stay in
    the folder until its owner clears it, as checkpoints do.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed(df: DataFrame, label: str = "input") -> DataFrame:
    """``df`` itself if it is a plain scan, whose rows come in the same order in every evaluation; else a stored copy.

    Operators that number rows and read their input more than once start from this.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.sub(r"^[\s:+-]*", "", line).split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    return df if nodes <= {"Relation", "Project", "Filter", "LocalRelation", "LogicalRDD"} else stage(df, label)


def row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows of a table, so that repeated and missing ids stay apart.

    The number depends on the file split and the place in it, so it is the same in every
    evaluation of a scan. Use it directly on a scan, a stored stage or :func:`fixed` data.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def fresh(df: DataFrame, name: str = "_rid") -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give back what a task held, for Python workers live on and serve other tasks: free Arrow buffers, and free pages of the C heap where the system can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join.

    ``df`` should be a stored stage or cheap, for it is read to learn the size.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII texts take the byte-wise path, with the same result."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
