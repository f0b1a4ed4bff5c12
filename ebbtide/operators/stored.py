"""Jobs that keep what they make: feature snapshots (D21), topic names (E6), explanations (F24) and retrained models."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.config import BASELINE_FEATURE_NAMES, FEATURE_NAMES, FeatureConfig, feature_schema_hash
from ebbtide.functions.trees import tree_nodes
from ebbtide.operators import features as D
from ebbtide.operators import training as TR
from ebbtide.operators.evaluation import compare_models
from ebbtide.operators.semantics import name_topics
from ebbtide.sources.bucketed import joined, write_bucketed
from ebbtide.sources.imports import stored, write_snapshot

MODEL_NAME = "multimodal_behavioral_risk"
#: Folders over which explanations are dealt, so that an upsert replaces those of its predictions only.
EXPLANATION_PARTS = 32


def run_feature_snapshot(
    path: str, customers: DataFrame, transactions: DataFrame, trusted: DataFrame, semantics: DataFrame, as_of: dt.date, config: FeatureConfig = FeatureConfig(), prior_days: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """Compute the snapshot of a date, store it through A14, and count what was stored: (stored snapshot, counters).

    Running it again for a date replaces the rows of the same customers and adds new ones.
    """
    rows = D.feature_snapshot(customers, transactions, trusted, semantics, as_of, config, prior_days)
    write_snapshot(rows, path)
    kept = stored(rows.sparkSession, path).filter(F.col("as_of_date") == F.lit(as_of))
    return kept, D.snapshot_counters(kept)


def store_vector_inputs(
    root: str, customers: DataFrame, transactions: DataFrame, trusted: DataFrame, semantics: DataFrame, as_of: dt.date, config: FeatureConfig = FeatureConfig(), mode: str = "persisted",
    prior_days: int = 30, buckets: int = 64,
) -> None:
    """What the feature vectors of a date are made of, stored in buckets of the customer: the customers themselves and their inputs.

    Parts are computed once and read by every job that needs vectors of the date; rows of customers not given are kept.
    """
    parts = {"spine": customers.select("customer_id", "created_at")}
    parts |= {n: p.drop("as_of_date") for n, p in D.vector_inputs(transactions, trusted, semantics, [as_of], config, mode, prior_days).items()}
    write_bucketed(customers.sparkSession, root, parts, as_of.isoformat(), buckets=buckets)


def stored_feature_vector(spark: SparkSession, root: str, as_of: dt.date, config: FeatureConfig = FeatureConfig(), mode: str = "persisted") -> DataFrame:
    """D15 from the stored parts of a date: buckets of one customer range meet where they lie, without a shuffle."""
    rows = joined(spark, root, ["spine", "purchases", "messages", "mood_now", "mood_before"], as_of.isoformat())
    return D.assembled_vector(rows.withColumn("as_of_date", F.lit(as_of)), config, mode)


def store_topics(topics: DataFrame, path: str, version: str, now: dt.datetime, replace: bool = False) -> DataFrame:
    """Names and keywords of the topics of a model version, upserted by (version, topic); returns the version's rows.

    ``topics`` has topic_idx and top_keywords; blank keywords are left out. ``replace`` drops topics of the version that are
    not given. A topic keeps the time at which it was first stored.
    """
    spark = topics.sparkSession
    clean = topics.withColumn("top_keywords", F.filter("top_keywords", lambda w: w.isNotNull() & (F.trim(w) != "")))
    rows = name_topics(clean.select("topic_idx", "top_keywords")).withColumns({"model_version": F.lit(version), "created_at": F.lit(now).cast("timestamp_ntz"), "updated_at": F.lit(now).cast("timestamp_ntz")})
    old = stored(spark, path)
    if old is not None:
        first = old.filter(F.col("model_version") == version).select("topic_idx", F.col("created_at").alias("_first"))
        rows = rows.join(first, "topic_idx", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
    if replace:
        # the version's folder is written anew; what is read for it was staged by the write below, not from that folder
        rows = spark.createDataFrame(rows.collect(), rows.schema)  # a row per topic
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version").parquet(path)
    else:
        write_snapshot(rows, path, ("topic_idx",), "model_version", files=1)
    return stored(spark, path).filter(F.col("model_version") == version)


def store_explanations(explanations: DataFrame, path: str) -> DataFrame:
    """explanations upserted by prediction; returns all that are stored."""
    rows = explanations.withColumn("part", F.pmod(F.xxhash64("pred_id"), F.lit(EXPLANATION_PARTS)).cast("int"))
    write_snapshot(rows, path, ("pred_id",), "part", files=1)
    return stored(explanations.sparkSession, path).drop("part")


def model_hash(nodes: DataFrame) -> str:
    """Digest of a fitted ensemble: its nodes in order (some thousand rows)."""
    told = hashlib.sha256()
    for r in nodes.orderBy("tree", "node").collect():
        told.update(repr(tuple(r)).encode())
    return told.hexdigest()


def interpretation(comparison: DataFrame) -> str:
    """What the comparison of the two models says, in words."""
    gain = {r["metric"]: r["improvement"] or 0.0 for r in comparison.collect()}  # a row per metric
    roc, f1 = gain.get("roc_auc", 0.0), gain.get("f1", 0.0)
    verb = "improves" if roc >= 0 and f1 >= 0 else "changes"
    value = "contribute additional predictive value beyond transactional behavior" if roc > 0 or f1 > 0 else "did not improve these validation metrics in the current split"
    return f"Multimodal model {verb} ROC-AUC by {roc:.3f} and F1-Score by {f1:.3f} compared to the transaction-only baseline. This indicates that customer interaction signals {value}."


def retrain_and_store(dataset: DataFrame, path: str, version: str, now: dt.datetime, trees: int = 100) -> DataFrame:
    """retrain, store both models with their metrics, the comparison and the version, and make the full model the active one.

    Below ``path``: ``models/<version>/<name>`` (the fitted pipelines), ``metrics`` (a row per version and model), ``comparison`` (a row
    per version and metric, with the wording), ``versions`` (a row per version; one is active). Storing a version again
    replaces its rows. Returns the comparison.
    """
    spark = dataset.sparkSession
    parts = TR.retrained(dataset, trees)
    both = {"baseline": BASELINE_FEATURE_NAMES, "multimodal": FEATURE_NAMES}
    at = F.lit(now).cast("timestamp_ntz")
    found, hashes = [], {}
    for (name, names), (model, metrics) in zip(both.items(), parts["models"], strict=True):
        model.write().overwrite().save(f"{path}/models/{version}/{name}")
        hashes[name] = model_hash(tree_nodes(model.stages[-1], spark))
        found.append(metrics.select("*", F.lit(name).alias("model"), F.lit(len(names)).alias("features")))
    rows = found[0].unionByName(found[1]).withColumns({"model_version": F.lit(version), "train_size": F.lit(parts["train_size"]), "test_size": F.lit(parts["test_size"]), "oversampled": F.lit(parts["oversampled"]), "trained_at": at})
    write_snapshot(rows, f"{path}/metrics", ("model",), "model_version", files=1)
    compared = spark.createDataFrame((c := compare_models(parts["models"][0][1], parts["models"][1][1])).collect(), c.schema)  # a row per metric
    write_snapshot(compared.withColumns({"model_version": F.lit(version), "interpretation": F.lit(interpretation(compared))}), f"{path}/comparison", ("metric",), "model_version", files=1)
    registered = spark.range(1).select(
        F.lit(MODEL_NAME).alias("model_name"), F.lit(version).alias("model_version"), F.lit(f"{path}/models/{version}/multimodal").alias("model_path"), F.lit(hashes["multimodal"]).alias("model_hash"),
        F.lit(feature_schema_hash()).alias("feature_schema_hash"), F.array(*[F.lit(n) for n in FEATURE_NAMES]).alias("feature_names"), F.lit(len(FEATURE_NAMES)).alias("expected_feature_count"),
        F.lit(parts["train_size"]).alias("training_data_count"), at.alias("training_date"), F.lit(True).alias("is_active"),
    )
    old = stored(spark, f"{path}/versions")
    if old is not None:
        others = old.filter(F.col("model_version") != version).withColumn("is_active", F.lit(False))
        registered = others.select(*registered.columns).unionByName(registered)
    write_snapshot(spark.createDataFrame(registered.collect(), registered.schema), f"{path}/versions", ("model_version",), "model_name", files=1)  # a row per version
    return compared.withColumn("model_version", F.lit(version))


def active_model(spark: SparkSession, path: str) -> DataFrame:
    """The registered version that is in use."""
    return stored(spark, f"{path}/versions").filter("is_active")
