"""Message identity, trust views and data governance (B operators)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.skew import salted_join

LINK_STATUSES = ("verified", "probable", "provisional", "rejected")
SIGNAL_COLUMNS = ("feature_id", "msg_length", "num_exclamations", "num_questions", "embedding", "processed_at")


def provisional_id(phone: Column) -> Column:
    """A stable id for a customer known by phone only, so that re-runs agree."""
    return F.sha2(F.concat(F.lit("provisional:"), phone), 256)


def link_messages(messages: DataFrame, customers: DataFrame, links: DataFrame) -> DataFrame:
    """B1: links for the messages without one.

    An unknown phone gets a provisional customer from its first message (by time, then id); its
    other messages match that customer. The first message is a partial aggregate per phone and
    is recognised by its own id, so no phone's messages need to meet in one task.
    """
    open_msgs = messages.filter(F.col("phone_number").isNotNull() & (F.col("phone_number") != "")).join(links.select("msg_id"), "msg_id", "left_anti")
    by_phone = customers.filter(F.col("phone_hash").isNotNull()).select(
        F.col("phone_hash").alias("phone_number"), F.col("customer_id").cast("string").alias("_cid"), F.coalesce("is_provisional", F.lit(False)).alias("_prov")
    )
    matched = salted_join(open_msgs, by_phone, ["phone_number"], ["msg_id"], "left")
    openers = (
        matched.filter(F.col("_cid").isNull()).groupBy("phone_number").agg(F.min(F.struct("timestamp", "msg_id")).alias("f"))
        .select(F.col("f.msg_id").alias("msg_id"), F.lit(True).alias("_opens"))
    )
    known, real = F.col("_cid").isNotNull(), F.col("_cid").isNotNull() & ~F.col("_prov")
    opens = F.coalesce(F.col("_opens"), F.lit(False))
    return matched.join(openers, "msg_id", "left").select(
        F.sha2(F.concat(F.lit("link:"), F.col("msg_id").cast("string")), 256).alias("link_id"),
        "msg_id", "phone_number",
        F.when(known, F.col("_cid")).otherwise(provisional_id(F.col("phone_number"))).alias("customer_id"),
        F.when(real, 1.0).when(opens, 0.5).otherwise(0.6).alias("match_confidence"),
        F.when(real, "phone_exact").when(opens, "auto_created_provisional").otherwise("phone_provisional").alias("match_method"),
        F.when(real, "probable").otherwise("provisional").alias("link_status"),
        opens.alias("creates_customer"),
    )


def provisional_customers(new_links: DataFrame) -> DataFrame:
    """B1: the customers that linking adds, one per unknown phone."""
    return new_links.filter("creates_customer").select(
        "customer_id", F.col("phone_number").alias("phone_hash"),
        F.concat(F.lit("[Provisional] "), F.substring("phone_number", 1, 8), F.lit("...")).alias("name"),
        F.lit(False).alias("consent_given"), F.lit(True).alias("is_provisional"),
    )


def linking_run_stats(new_links: DataFrame) -> DataFrame:
    """Links of one run by the method names that are really produced."""
    return new_links.groupBy("match_method", "link_status").agg(F.count(F.lit(1)).alias("messages"))


def linking_stats(messages: DataFrame, links: DataFrame) -> DataFrame:
    """B2: totals and confidence buckets, as one row."""
    raw = messages.agg(F.count(F.lit(1)).alias("n")).scalar()
    c = F.col("match_confidence")
    return links.agg(
        F.count(F.lit(1)).alias("total_linked"), F.count_if(c >= 0.9).alias("high_confidence"),
        F.count_if((c >= 0.7) & (c < 0.9)).alias("medium_confidence"), F.count_if(c < 0.7).alias("low_confidence"),
    ).select(raw.alias("total_raw"), "total_linked", (raw - F.col("total_linked")).alias("unlinked"), "high_confidence", "medium_confidence", "low_confidence")


def trusted_feedback(messages: DataFrame, links: DataFrame, features: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Messages with link and extracted signals for the accepted statuses."""
    signals = features.select("link_id", *[c for c in SIGNAL_COLUMNS if c in features.columns])
    kept = links.filter(F.col("link_status").isin(*statuses)).select("link_id", "msg_id", "customer_id", "match_confidence", "link_status")
    return messages.select("msg_id", "phone_number", "text", "timestamp", "direction").join(kept, "msg_id").join(signals, "link_id", "left")


def trusted_feedback_ml(messages: DataFrame, links: DataFrame, features: DataFrame) -> DataFrame:
    return trusted_feedback(messages, links, features, ("verified",))


def trusted_feedback_dashboard(messages: DataFrame, links: DataFrame, features: DataFrame) -> DataFrame:
    return trusted_feedback(messages, links, features, ("verified", "probable"))


def real_customers(customers: DataFrame) -> DataFrame:
    """Everyone not known to be provisional."""
    return customers.filter(~F.coalesce("is_provisional", F.lit(False)))


def semantic_embeddings(links: DataFrame, features: DataFrame, statuses: tuple[str, ...], registry: DataFrame | None = None) -> DataFrame:
    """Vectors of accepted links; with a registry only unversioned ones or the active version."""
    vectors = features.filter(F.col("embedding").isNotNull()).select("link_id", "embedding", "embedding_model_version", "processed_at")
    if registry is not None:
        active = registry.filter("is_active").agg(F.min("model_version").alias("v")).scalar()
        version = F.col("embedding_model_version")
        vectors = vectors.filter(version.isNull() | (version == active))
    return links.filter(F.col("link_status").isin(*statuses)).select("customer_id", "link_id", "link_status").join(vectors, "link_id")


def relabel_link_status(links: DataFrame) -> DataFrame:
    """Status from confidence where none was set by hand."""
    fresh = F.when(F.col("match_confidence") >= 0.7, "probable").otherwise("provisional")
    unset = F.col("link_status").isNull() | (F.col("link_status") == "provisional")
    return links.withColumn("link_status", F.when(unset, fresh).otherwise(F.col("link_status")))


def flag_provisional_names(customers: DataFrame) -> DataFrame:
    """Names given by automatic creation mark a customer as provisional."""
    auto = F.col("name").like("Customer\\_%") | F.col("name").startswith("[Provisional]")
    return customers.withColumn("is_provisional", F.coalesce(auto, F.lit(False)) | F.coalesce("is_provisional", F.lit(False)))


def backfill_links(features: DataFrame, links: DataFrame) -> DataFrame:
    """Links for featured messages that have none (one per message), then link ids filled in."""
    first = features.filter(F.col("msg_id").isNotNull()).groupBy("msg_id").agg(F.min_by("customer_id", "feature_id").alias("customer_id"))
    added = first.join(links.select("msg_id"), "msg_id", "left_anti").select(
        F.sha2(F.concat(F.lit("link:"), F.col("msg_id").cast("string")), 256).alias("link_id"), "msg_id", "customer_id",
        F.lit(1.0).alias("match_confidence"), F.lit("legacy_migration").alias("match_method"),
    )
    every = links.select(F.col("link_id").cast("string").alias("link_id"), "msg_id").unionByName(added.select("link_id", "msg_id"))
    return features.drop("link_id").join(every, "msg_id", "left")


def backfill_phones(messages: DataFrame, customers: DataFrame) -> DataFrame:
    """Missing phone hashes from the owning customer, else 'unknown'."""
    phones = customers.select("customer_id", F.col("phone_hash").alias("_p"))
    return messages.join(phones, "customer_id", "left").withColumn("phone_number", F.coalesce("phone_number", "_p", F.lit("unknown"))).drop("_p")


def split_legacy(legacy: DataFrame, existing: DataFrame, columns: tuple[str, ...], require_any: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one snapshot table out of a wide legacy table, existing keys left alone."""
    key = ["customer_id", "as_of_date"]
    rows = legacy.select(*key, *columns)
    if require_any:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in require_any]))
    return rows.join(existing.select(*key), key, "left_anti")


def integrity_report(links: DataFrame, features: DataFrame, messages: DataFrame, customers: DataFrame) -> DataFrame:
    """Violated rules with the number of offending rows."""
    owner = links.select("link_id", F.col("customer_id").alias("_owner"))
    joined = features.select("feature_id", "link_id", "customer_id").join(owner, "link_id", "left")

    def rule(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")

    def repeated(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).count().filter("count > 1")

    rules = [
        rule("feature_link_customer_mismatch", joined.filter(F.col("_owner").isNotNull() & (F.col("_owner") != F.col("customer_id")))),
        rule("feature_without_link", joined.filter(F.col("link_id").isNotNull() & F.col("_owner").isNull())),
        rule("confidence_out_of_range", links.filter(~F.col("match_confidence").between(0, 1))),
        rule("unknown_link_status", links.filter(~F.col("link_status").isin(*LINK_STATUSES))),
        rule("repeated_link_message", repeated(links, "msg_id")),
        rule("repeated_feature_link", repeated(features, "link_id")),
        rule("link_without_message", links.join(messages.select("msg_id"), "msg_id", "left_anti")),
        rule("link_without_customer", links.join(customers.select("customer_id"), "customer_id", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, rules)


def erase_customers(tables: dict[str, DataFrame], erase: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of erased customers."""
    ids = erase.select("customer_id").distinct()
    return {name: df.join(ids, "customer_id", "left_anti") for name, df in tables.items()}


def unlink_erased_predictions(actions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Actions keep their row but lose the reference to a prediction that is gone."""
    left = predictions.select("pred_id", F.lit(True).alias("_kept"))
    return actions.join(left, "pred_id", "left").withColumn("pred_id", F.when(F.col("_kept"), F.col("pred_id"))).drop("_kept")
