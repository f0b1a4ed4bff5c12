"""Global vector search over a stored index: cells around centroids, read in order of their bounds until none can matter."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import TRUSTED_STATUSES
from ebbtide.functions import vectors as V
from ebbtide.functions.text import truncate

#: Vectors from which centroids are fitted, at most, and cells at most. Every vector is placed, whatever the sample.
SAMPLE, MAX_CELLS = 100_000, 4096
#: Guard against rounding in angles.
SLACK = 1e-6
#: Cell of vectors without a direction (all zero, or of another length); their similarity is 0.
NOWHERE = -1


def message_vectors(features: DataFrame, links: DataFrame, messages: DataFrame) -> DataFrame:
    """What the index of messages holds: one row per embedded and linked message that exists."""
    known = features.filter(F.col("embedding").isNotNull()).drop("customer_id").join(links.select("link_id", "customer_id", "link_status"), "link_id")
    return known.join(messages.select("msg_id"), "msg_id", "left_semi").select("feature_id", "link_id", "msg_id", "customer_id", "link_status", "processed_at", "embedding")


def _unit(rows: DataFrame, vector: str, size: int) -> DataFrame:
    return rows.withColumn("_fits", F.coalesce((F.size(vector) == size) & ~V.is_zero(F.col(vector)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))


def build_vector_index(rows: DataFrame, path: str, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, file_rows: int = 100_000, seed: int = 42) -> None:
    """Store ``rows`` below ``path``, by cell and inside a cell by the angle to its centroid.

    Centroids are fitted on at most ``sample`` vectors; every row is placed in the cell of its nearest centroid. Files are cut by
    (cell, angle), so a cell with a third of all rows is many files, each of a narrow ring. The summary of the cells
    (rows, least and greatest angle, centroid; MAX_CELLS at most) is written last: without it there is no index. Rows
    without a vector are left out.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(vector).isNotNull())
    sizes = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    fits = _unit(rows, vector, size)
    n = fits.filter("_fits").count()
    cells = min(cells or max(1, math.isqrt(n) // 4), MAX_CELLS)
    centres = np.zeros((0, size))
    if n:
        key = F.pmod(F.xxhash64(F.col(vector).cast("array<double>"), F.lit(seed)), F.lit(1 << 30))
        some = fits.filter("_fits").filter(key <= int(min(1.0, sample / n) * (1 << 30)))
        some = some if not some.isEmpty() else fits.filter("_fits").limit(cells)
        learned = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=10).fit(some.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
        centres = np.array([c / (np.linalg.norm(c) or 1.0) for c in learned.clusterCenters()])
    told = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<cell:int,angle:double>")
    def placed(col: pa.Array, good: pa.Array) -> pa.Array:
        known = good.to_numpy(zero_copy_only=False)
        cell, angle = np.full(len(col), NOWHERE, np.int32), np.full(len(col), math.pi)
        if known.any():
            x = col.filter(good).flatten().to_numpy(zero_copy_only=False).reshape(known.sum(), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = (x @ told.value.T).argmax(1)
            cell[known] = near
            angle[known] = 2 * np.arcsin(np.minimum(1.0, np.linalg.norm(x - told.value[near], axis=1) / 2))  # by the chord, exact for small angles
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], ["cell", "angle"])

    spots = fits.withColumn("_p", placed(F.col(vector).cast("array<double>"), F.col("_fits"))).withColumns({"cell": F.col("_p.cell"), "angle": F.col("_p.angle")}).drop("_p", "_fits")
    files = max(1, -(-n // file_rows))
    spots.repartitionByRange(files, "cell", "angle").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{path}/vectors")
    spots.limit(0).coalesce(1).write.parquet(f"{path}/shape")  # the columns, for an index without rows has none
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(NOWHERE, [])], "cell int, centre array<double>")
    stored = spark.read.schema(spots.schema).parquet(f"{path}/vectors")
    summary = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    summary.join(F.broadcast(listed), "cell").withColumn("size", F.lit(size)).coalesce(1).write.parquet(f"{path}/cells")


@dataclass(frozen=True)
class Reading:
    """What a search read: cells and rows of the index, and how many there are."""

    cells: int
    all_cells: int
    rows: int
    all_rows: int


def similarity(vector: Column, query: list[float]) -> Column:
    """max(0, 1 - cosine distance / 2)."""
    return F.greatest(F.lit(0.0), (1 + V.cosine(vector, F.lit([float(x) for x in query]))) / 2)


def search_index(spark: SparkSession, path: str, query: list[float], n: int, where: Column | None = None, vector: str = "embedding", tie: str = "feature_id") -> tuple[DataFrame, Reading]:
    """The ``n`` rows most similar to ``query`` among those that ``where`` holds for, as the full scan gives them, and what was read.

    A cell can hold no vector nearer than its centroid's angle to the query less its greatest angle (or its least angle less that). Cells
    are read in the order of that bound, one, two, four at a time; the search stops at the first cell whose bound is beyond the
    ``n``-th best so far, and inside later cells only the ring within that reach is read, which the files' statistics prune. Equal
    similarities are ordered by ``tie``. Fewer than ``n`` rows are all rows. ``n`` rows reach the driver.
    """
    schema = spark.read.parquet(f"{path}/shape").schema
    stats = spark.read.parquet(f"{path}/cells").collect()  # MAX_CELLS at most
    asked = np.array([float(x) for x in query])
    long = float(np.linalg.norm(asked)) if len(asked) else 0.0
    listed = []
    for r in stats:
        if not long or len(asked) != r["size"] or r["cell"] == NOWHERE:
            bound = math.pi if long and len(asked) == r["size"] else 0.0
            listed.append((bound, math.pi, r))
            continue
        to = 2 * math.asin(min(1.0, float(np.linalg.norm(asked / long - np.array(r["centre"]))) / 2))
        listed.append((max(0.0, to - r["high"], r["low"] - to), to, r))
    listed.sort(key=lambda c: (c[0], c[1], c[2]["cell"]))
    every = spark.read.schema(schema).parquet(f"{path}/vectors")
    every = every.filter(where) if where is not None else every
    best, reach, at, wave, rows = [], math.inf, 0, 1, 0
    while at < len(listed) and listed[at][0] <= reach:
        some = [c for c in listed[at : at + wave] if c[0] <= reach]
        part = every.filter(F.col("cell").isin([c[2]["cell"] for c in some]))
        if reach < math.inf:
            ring = None
            for _, to, r in some:
                low, high = (0.0, math.pi) if r["cell"] == NOWHERE else (to - reach, to + reach)
                one = (F.col("cell") == r["cell"]) & F.col("angle").between(low, high)
                ring = one if ring is None else ring | one
            part = part.filter(ring)
        scored = part.withColumn("_s", similarity(F.col(vector), query))
        best += scored.orderBy(F.desc("_s"), tie).limit(n).drop("cell", "angle").collect()
        best = sorted(best, key=lambda r: (-r["_s"], r[tie]))[:n]
        if len(best) == n:
            reach = math.acos(max(-1.0, min(1.0, 2 * best[-1]["_s"] - 1))) + SLACK
        at, wave, rows = at + len(some), wave * 2, rows + sum(c[2]["rows"] for c in some)
    kept = [f for f in schema if f.name not in ("cell", "angle")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = spark.createDataFrame([(*[r[f.name] for f in kept], r["_s"], k) for k, r in enumerate(best, 1)], f"{fields}, similarity double, rank int")
    return out, Reading(at, len(listed), rows, sum(r["rows"] for r in stats))


def global_nearest_messages(
    spark: SparkSession, path: str, messages: DataFrame, query: list[float], as_of: dt.datetime, n: int = 5, statuses: tuple[str, ...] = TRUSTED_STATUSES,
) -> tuple[DataFrame, Reading]:
    """F23 over all customers: the trusted messages before ``as_of`` most similar to a vector, by the stored index."""
    where = F.col("link_status").isin(*statuses) & (F.col("processed_at") <= F.lit(as_of).cast("timestamp_ntz"))
    found, reading = search_index(spark, path, query, n, where)
    told = messages.select("msg_id", "text", "timestamp").join(F.broadcast(found), "msg_id")  # n rows
    return told.select(
        "rank", "customer_id", "feature_id", "link_id", "msg_id", truncate(F.col("text"), 200).alias("text_snippet"), "timestamp", "link_status", F.round("similarity", 4).alias("similarity_score")
    ), reading
