"""Connected components by alternating stars, for links that fit no single task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges``: u, v with u > v, distinct.

    Large star: every neighbour greater than u is tied to the least neighbour of u (or u itself).
    Small star: u and its lesser neighbours are tied to the least of them. The least neighbour is a
    partial aggregate, and the join back on u has one row per node on one side, so the rows of a hot
    node are split by adaptive skew handling.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links over comparable ids -> (node, root), root the least id reachable; only linked nodes.

    Null ends and loops are ignored. Every round is stored in the shared folder. The number of
    rounds grows with the logarithm of the longest chain; running out of ``max_rounds`` is an error.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNull() | F.col("v").isNull()).alias("_n"))
    now = stage(pairs.filter("not _n and u > v").select("u", "v").distinct(), "links")
    now = stage(_star(now, False), "links")  # a node tied to many others leaves one row for itself
    state = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"] or mark == state:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        state = mark
        now = stage(_star(_star(now, True), False), "links")
    raise RuntimeError("components did not settle")


def fold(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least labels after joining positions i and j; ``labels`` points at positions, roots at themselves."""
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels
