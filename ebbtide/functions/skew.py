"""Helpers that keep hot keys from landing whole in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.session import cut_lineage


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key. Spark trims every map task to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_with_ties(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """All rows at the newest value per key (ties kept), trimmed before the shuffle as in :func:`top_n`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.rank().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def mark_first(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Flag the row with the least ``order`` per key.

    The least value is a partial aggregate, and the join back is on key *and* order value,
    so a key that fills a third of the table is still spread over all tasks.
    """
    firsts = (
        df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
        .groupBy(*keys)
        .agg(F.min(order).alias(order))
        .withColumn(flag, F.lit(True))
    )
    return df.join(firsts, [*keys, order], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """Keys holding more than ``share`` of the rows: fewer than ``1 / share`` of them, whatever the data.

    The rows are read once: their counts per key are stored, and the total and the hot keys come from there.
    """
    counts = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n").alias("t")).first()["t"] or 0
    return counts.filter(F.col("_n") > total * share).select(*keys)


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_on: list[str], how: str = "inner", salts: int = 32
) -> DataFrame:
    """Join facts to one-row-per-key data with hot keys split over ``salts`` tasks.

    Only the hot keys of ``big`` are replicated on the other side; the list of hot keys is
    bounded by construction (see :func:`hot_keys`), so broadcasting it is safe at any scale.
    """
    hot = hot_keys(big.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), keys)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_on), F.lit(salts))).otherwise(F.lit(0))
    left = big.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
