"""Session helpers: settings for local runs and lineage cutting that survives executor loss."""

from __future__ import annotations

import atexit
import functools
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ebbtide")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> str:
    """Send this package to the executors, and return the archive that holds it.

    Arrow operators run library code in Python workers, which must be able to import it. Call this once per session where the package is
    not installed on the executors (an installed one, or ``spark-submit --py-files`` with this archive, does as well).
    """
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="ebbtide-ship-")) / "ebbtide.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the folder that driver and executors share.

    The root is ``spark.checkpoint.dir`` of the session, else the checkpoint folder set on the
    context. Only a local master, whose driver and executors are one process, may go without; any
    other master is refused, because each executor would write to its own disk.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.cache
def _local_root() -> str:
    """One temporary folder per process for sessions on a local master; it goes when the process ends."""
    root = tempfile.mkdtemp(prefix="ebbtide-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable checkpoint storage below :func:`shared_folder` and read it back."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)
