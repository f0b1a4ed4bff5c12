"""Model metrics, comparisons and feature profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.ranking import cumulative, exact_quantiles

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def _share(top: Column, under: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), under.cast("double")), F.lit(0.0))


def classification_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """confusion metrics at a threshold, ROC-AUC, average precision and class sizes for (y, score).

    Everything is read off the counts per distinct score: the confusion counts, the tie-averaged
    rank sum behind ROC-AUC and the step sum behind average precision. Running counts run inside
    score buckets. ROC-AUC and average precision are 0 where only one class occurs.
    """
    y = F.col("y")
    by_score = scores.groupBy("score").agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    run = cumulative(by_score, "score", ["pos", "neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)
    above_pos = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    above_neg = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    steps = F.col("pos") * F.try_divide(above_pos.cast("double"), above_pos + above_neg)
    hit = F.col("score") >= threshold
    sums = run.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(wins).alias("wins"), F.sum(steps).alias("steps"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
    )
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    both = (p > 0) & (n > 0)
    values = {
        "accuracy": _share(tp + n - fp, p + n), "precision": _share(tp, tp + fp), "recall": _share(tp, p), "f1": _share(2 * tp, tp + fp + p),
        "roc_auc": F.when(both, F.try_divide(F.col("wins"), p * n.cast("double"))).otherwise(0.0),
        "pr_auc": F.when(both, F.try_divide(F.col("steps"), p)).otherwise(0.0),
    }
    return sums.select(*[F.round(v, 4).alias(k) for k, v in values.items()], (p + n).alias("rows"), p.alias("positives"), n.alias("negatives"))


def threshold_sweep(scores: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """precision, recall, F1 and flagged rows per threshold, from one pass."""
    y, pos = F.col("y"), F.count_if(F.col("y") == 1)
    one = scores.agg(pos.alias("pos"), *[a for i, t in enumerate(thresholds) for a in (
        F.count_if(F.col("score") >= t).alias(f"flag_{i}"), F.count_if((F.col("score") >= t) & (y == 1)).alias(f"tp_{i}"))])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"flag_{i}").alias("flagged"), F.col(f"tp_{i}").alias("tp"), "pos") for i, t in enumerate(thresholds)])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    return r.select(
        "threshold", F.round(_share(F.col("tp"), F.col("flagged")), 4).alias("precision"), F.round(_share(F.col("tp"), F.col("pos")), 4).alias("recall"),
        F.round(_share(2 * F.col("tp"), F.col("flagged") + F.col("pos")), 4).alias("f1_score"), F.col("flagged").alias("high_risk_customers"),
    )


def compare_models(baseline: DataFrame, multimodal: DataFrame) -> DataFrame:
    """metric rows of two models and the gain."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in METRICS])
        return df.select(F.explode(rows).alias("r")).select("r.*")

    return long(baseline, "baseline").join(long(multimodal, "multimodal"), "metric").withColumn(
        "improvement", F.round(F.coalesce("multimodal", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0)), 4)
    )


def contribution_importance(contributions: DataFrame) -> DataFrame:
    """mean absolute contribution per feature, the stand-in for model importances."""
    return contributions.filter("feature IS NOT NULL AND contribution IS NOT NULL").groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def importance_shares(importance: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """evenness 1 - sum(p^2) of importances and the share of feature groups in percent."""
    total = importance.agg(F.sum("importance").alias("t")).scalar()
    p = F.try_divide(F.col("importance"), F.col("_t"))
    return importance.withColumn("_t", total).agg(
        (1 - F.sum(p * p)).alias("concentration"),
        *[F.coalesce(F.sum(F.when(F.col("feature").isin(*names), p * 100)), F.lit(0.0)).alias(f"{g}_percent") for g, names in groups.items()],
    )


def model_health(metrics: DataFrame) -> DataFrame:
    """mean of recall, F1 and ROC-AUC, and the grade it earns."""
    parts = F.filter(F.array("recall", "f1", "roc_auc"), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v), F.size(parts))
    return metrics.withColumn("health_score", mean).withColumn(
        "performance_status", F.when(F.col("health_score") >= 0.75, "Baik").when(F.col("health_score") >= 0.6, "Cukup").otherwise("Perlu Perhatian")
    )


# ---------------------------------------------------------------------------------------------
# Feature profiles over long (feature, value) rows
# ---------------------------------------------------------------------------------------------
def describe_features(long: DataFrame) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per feature."""
    base = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    q = exact_quantiles(long, "feature", "value", [0.25, 0.5, 0.75])
    wide = q.groupBy("feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(wide, "feature", "left")


def histogram(long: DataFrame, bins: int = 30) -> DataFrame:
    """counts in equal-width bins between the least and largest value of each feature."""
    span = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    # the bin is known right after the broadcast of one row per feature, so a task sends at most bins x features rows
    placed = long.filter("value IS NOT NULL").join(F.broadcast(span), "feature")
    return placed.groupBy("feature", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def group_comparison(long: DataFrame, label: str = "label") -> DataFrame:
    """means and sample stds of low (0) and high (1) rows and the difference in percent of the low mean."""
    low, high = F.when(F.col(label) == 0, F.col("value")), F.when(F.col(label) == 1, F.col("value"))
    out = long.groupBy("feature").agg(
        F.avg(low).alias("low_mean"), F.avg(high).alias("high_mean"), F.stddev_samp(low).alias("low_std"), F.stddev_samp(high).alias("high_std")
    )
    return out.withColumn("diff_pct", F.try_divide(F.col("high_mean") - F.col("low_mean"), F.nullif("low_mean", F.lit(0.0))) * 100)


def proxy_label(df: DataFrame, column: str = "recency_days") -> DataFrame:
    """rows above the median of ``column`` count as high risk where no label exists."""
    one = df.select(F.lit(column).alias("feature"), F.col(column).cast("double").alias("value"))
    middle = exact_quantiles(one, "feature", "value", [0.5]).select("quantile").scalar()
    return df.withColumn("label", (F.col(column) > middle).cast("int"))


def correlations(df: DataFrame, names: tuple[str, ...], above: float = 0.95) -> DataFrame:
    """feature pairs whose absolute Pearson correlation exceeds ``above``.

    Every pair uses the rows where both features are present, whatever the others lack; NaN is missing. Values are taken relative
    to the feature's mean, so that large offsets do not eat the digits. A task multiplies its batches with themselves
    and sends one row of sums per pair; those are added up and compared in Spark.
    """
    means = df.agg(*[F.avg(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double"))).alias(n) for n in names]).first()  # a number per feature
    centre = np.array([float(means[n] or 0.0) for n in names])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(names), len(names)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - centre if batch.num_rows else np.zeros((0, len(names)))
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            s, q = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, s, s.T, q, q.T, x.T @ x])
        i, j = np.triu_indices(len(names), 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(total[k, i, j]) for k in range(6)]], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = df.select(*[F.col(n).cast("double") for n in names]).mapInArrow(sums, "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double")
    one = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    c = {x: F.col(x) for x in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    vx, vy = c["n"] * c["sxx"] - c["sx"] * c["sx"], c["n"] * c["syy"] - c["sy"] * c["sy"]
    # what a constant feature leaves is rounding, not variance
    real = (vx > 1e-12 * c["n"] * c["sxx"]) & (vy > 1e-12 * c["n"] * c["syy"])
    r = F.when(real, (c["n"] * c["sxy"] - c["sx"] * c["sy"]) / (F.sqrt(vx) * F.sqrt(vy)))
    listed = F.lit(list(names))
    named = one.select(F.element_at(listed, (F.col("i") + 1).cast("int")).alias("feature_1"), F.element_at(listed, (F.col("j") + 1).cast("int")).alias("feature_2"), r.alias("correlation"))
    return named.filter(F.abs("correlation") > above)


def edge_cases(long: DataFrame, capped: tuple[str, ...] = ("activity_cv", "spend_volatility_cv"), cap: float = 9.99) -> DataFrame:
    """missing, zero, capped and more-than-3-sigma values per feature."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    v = F.col("value")
    return long.join(F.broadcast(stats), "feature").groupBy("feature").agg(
        F.count_if(v.isNull()).alias("missing"), F.count_if(v == 0).alias("zero"),
        F.count_if(F.col("feature").isin(*capped) & (v >= cap)).alias("capped"),
        F.count_if((F.col("s") > 0) & (F.abs(v - F.col("m")) > 3 * F.col("s"))).alias("outliers"),
    )
