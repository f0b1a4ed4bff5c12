"""Exact global ranks and quantiles without a single-partition sort."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.session import cut_lineage

#: Order buckets at least, and rows of a bucket above which more are made.
BUCKETS, BUCKET_ROWS = 200, 1_000_000


def _bounds(df: DataFrame, order: str, group: str | None) -> dict:
    """Approximate split points per group: some hundred numbers for each of a few groups, more where rows are many."""

    def cuts(n: int) -> list:
        probs = [i / n for i in range(1, n)]
        aggs = F.percentile_approx(order, probs, max(1000, 5 * n)).alias("b"), F.count(order).alias("n")
        return (df.groupBy(group) if group else df.groupBy(F.lit(None).alias("_g"))).agg(*aggs).collect()

    found = cuts(BUCKETS)
    wanted = -(-max((r["n"] for r in found), default=0) // BUCKET_ROWS)
    if wanted > BUCKETS:
        found = cuts(wanted)
    return {r[0]: sorted(set(r["b"] or [])) for r in found}


def _bucket(order: str, group: str | None, bounds: dict) -> Column:
    """Number of split points below the value, found in two steps: among every k-th point, then among the next k."""
    step = max(1, math.isqrt(max((len(c) for c in bounds.values()), default=0)))

    def points(every: int) -> Column:
        if group is None:
            return _array(next(iter(bounds.values()), [])[every - 1 :: every])
        names = [x for name, cuts in bounds.items() for x in (F.lit(name), _array(cuts[every - 1 :: every]))]
        return F.coalesce(F.try_element_at(F.create_map(*names), F.col(group)), _array([])) if names else _array([])

    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(order)))
    coarse = below(points(step)) * step
    return coarse + below(F.slice(points(1), coarse + 1, step))


def _array(cuts: list) -> Column:
    return F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")


def cumulative(df: DataFrame, order: str, values: list[str], group: str | None = None) -> DataFrame:
    """Running totals of ``values`` in ascending ``order``, adding ``cum_<value>`` and ``all_<value>``.

    ``df`` has one row per order value (aggregate first). Rows are cut into order buckets; bucket
    totals (a few hundred rows) give the offsets, and the running sum runs inside buckets only.
    ``group`` names a column with few values, such as a feature name.
    """
    bounds = _bounds(df, order, group)
    cut = df.withColumn("_b", _bucket(order, group, bounds))
    keys = [group] if group else []
    totals = cut.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    by_bucket = Window.partitionBy(*keys, F.lit(0)).orderBy("_b")
    every = Window.partitionBy(*keys, F.lit(0))
    offsets = totals.select(
        *keys,
        "_b",
        *[
            F.coalesce(F.sum(f"_t_{v}").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{v}")
            for v in values
        ],
        *[F.sum(f"_t_{v}").over(every).alias(f"all_{v}") for v in values],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = cut.select("*", *[F.sum(v).over(inside).alias(f"_r_{v}") for v in values])
    out = running.join(F.broadcast(offsets), [*keys, "_b"])
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_r_{v}") + F.col(f"_o_{v}"))
    return out.drop("_b", *[f"_r_{v}" for v in values], *[f"_o_{v}" for v in values])


def exact_quantiles(df: DataFrame, group: str, value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group as rows (group, prob, quantile).

    Equal values are counted first (partial aggregation). The counted values are range-partitioned by (group, value) once and stored; the
    counts per partition and group, a few numbers each, say in which partition the order statistics next to each quantile lie, and
    one pass over the stored partitions reads them off. ``group`` has few values, such as feature names.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut_lineage(counts.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"), "_n").repartitionByRange("_g", "_v").sortWithinPartitions("_g", "_v")).withColumn("_pid", F.spark_partition_id())
    sizes = placed.groupBy("_g", "_pid").agg(F.sum("_n").alias("n")).collect()  # one number per partition and group at most
    before, totals = {}, {}
    for r in sorted(sizes, key=lambda r: r["_pid"]):
        before[r["_g"], r["_pid"]] = totals.get(r["_g"], 0)
        totals[r["_g"]] = totals.get(r["_g"], 0) + r["n"]
    wanted = {g: sorted({k for p in probs for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}) for g, n in totals.items()}
    told = df.sparkSession.sparkContext.broadcast((before, wanted))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, wanted = told.value
        group, passed = None, 0
        for b in batches:
            listed = b.column("_g").to_pylist()
            cuts = [0, *[k for k in range(1, len(listed)) if listed[k] != listed[k - 1]], len(listed)]
            out = []
            for p, q in zip(cuts, cuts[1:]):
                if p == q:
                    continue
                if listed[p] != group:
                    group, passed = listed[p], before[listed[p], b.column("_pid")[p].as_py()]
                upto = passed + np.cumsum(b.column("_n").to_numpy()[p:q])
                for k in wanted[group]:
                    if passed <= k < upto[-1]:
                        out.append((group, k, b.column("_v")[p + int(np.searchsorted(upto, k, "right"))].as_py()))
                passed = int(upto[-1])
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("_g").type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["g", "k", "v"])

    kind = df.schema[group].dataType.simpleString()
    at = {(r["g"], r["k"]): r["v"] for r in placed.mapInArrow(found, f"g {kind}, k long, v double").collect()}  # two numbers per group and quantile
    rows = []
    for g, n in totals.items():
        for p in probs:
            low, high = at[g, math.floor((n - 1) * p)], at[g, math.ceil((n - 1) * p)]
            rows.append((g, float(p), low + (high - low) * ((n - 1) * p - math.floor((n - 1) * p))))
    return df.sparkSession.createDataFrame(rows, f"`{group}` {kind}, prob double, quantile double")


def global_position(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """Zero-based position in the global order of ``order`` (unique together), for any sortable type.

    Rows are range-partitioned and sorted inside partitions, then written to checkpoint storage
    so that partitions stay as they are; partition sizes give the offsets.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = placed.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = {r["_pid"]: r["n"] for r in numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number per partition
    start, offsets = 0, []
    for pid in range(max(sizes, default=-1) + 1):
        offsets.append(start)
        start += sizes.get(pid, 0)
    offset = F.element_at(F.lit(offsets or [0]), F.col("_pid") + 1).cast("bigint")
    return numbered.withColumn(out, F.col("_in") + offset).drop("_pid", "_in")
