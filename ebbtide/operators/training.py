"""Leak-free training sets, class balance, model fitting."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.config import BASELINE_FEATURE_NAMES, FEATURE_NAMES, NEUTRALIZED_FEATURES, FeatureConfig, RiskThresholds, feature_schema_hash
from ebbtide.functions import boosting
from ebbtide.functions.neighbours import nearest_join
from ebbtide.functions.ranking import exact_quantiles, global_position
from ebbtide.functions.risk import risk_floor, risk_label
from ebbtide.operators import features as D
from ebbtide.operators.evaluation import classification_metrics, compare_models
from ebbtide.session import cut_lineage

CID, OBS, AS_OF = "customer_id", "observation_date", "as_of_date"
#: Rows of a part of a fit, some 100 MB in memory, above which there are more parts than cores.
FIT_ROWS = 500_000


def training_cutoff(transactions: DataFrame, messages: DataFrame | None = None, label_days: int = 90) -> dt.date:
    """the latest date whose whole label window lies inside the data."""
    return D.anchor_date(transactions, messages) - dt.timedelta(label_days)


def observation_dates(transactions: DataFrame, cutoff: dt.date, history_days: int = 90) -> DataFrame:
    """month starts with enough history up to the cutoff, and the cutoff itself."""
    earliest = F.date_add(F.min(F.to_date("tx_date")), history_days)
    month = F.trunc("earliest", "month")
    first = F.when(month == F.col("earliest"), month).otherwise(F.add_months(month, 1))
    months = F.when(first <= F.lit(cutoff), F.sequence(first, F.lit(cutoff), F.expr("INTERVAL 1 MONTH"))).otherwise(F.array().cast("array<date>"))
    one = transactions.filter("status = 'completed'").agg(earliest.alias("earliest")).filter("earliest IS NOT NULL")
    return one.select(F.explode(F.array_distinct(F.concat(months, F.array(F.lit(cutoff))))).alias(OBS))


def date_list(dates: DataFrame) -> list[dt.date]:
    """Observation dates as values: one per month of history."""
    return sorted(r[0] for r in dates.collect())


def churn_labels(transactions: DataFrame, dates: list[dt.date], label_days: int = 90, parts: int | None = None) -> DataFrame:
    """per customer with an earlier purchase and date, whether none follows in [date, date + label_days).

    The next purchase day comes from the interval (previous active day, active day] that holds the
    date, the last one from the interval before it: one window over active days, no range join.
    ``parts`` is the number of parts that customers are dealt over, for a day becomes a row for every date it is the newest before.
    """
    days = transactions.filter("status = 'completed'").select(CID, F.to_date("tx_date").alias("day")).distinct()
    if parts:
        days = days.repartition(max(parts, days.sparkSession.sparkContext.defaultParallelism), CID)
    w = Window.partitionBy(CID).orderBy("day")
    spans = days.select(CID, "day", F.lag("day").over(w).alias("prev"), F.lead("day").over(w).alias("next"))
    all_dates = D.date_array(dates)
    # dates after this day and not after the next one: last purchase = day, next purchase = next
    held = F.filter(all_dates, lambda d: (F.col("day") < d) & (F.col("next").isNull() | (d <= F.col("next"))))
    rows = spans.select(CID, F.explode(held).alias(OBS), F.col("day").alias("last_tx_before"), F.col("next").alias("next_tx"))
    return rows.withColumns({
        "outcome_date": F.date_add(OBS, label_days),
        "days_to_next_tx": F.datediff("next_tx", OBS),
        "churned": F.when(F.col("next_tx") < F.date_add(OBS, label_days), 0).otherwise(1),
    }).drop("next_tx")


def training_dataset(
    customers: DataFrame, transactions: DataFrame, trusted: DataFrame, semantics: DataFrame, dates: list[dt.date],
    config: FeatureConfig = FeatureConfig(), label_days: int = 90, min_tenure: int | None = None,
) -> DataFrame:
    """features as of the day before each observation date, label from that date on.

    Eligible are active real customers created before the date with an earlier purchase. Spine rows
    exist for eligible pairs only, so customers are never crossed with dates they cannot appear at.
    """
    real = customers.filter(F.col("is_active") & (F.col("is_provisional") == F.lit(False))).select(CID, "created_at")
    parts = -(-real.count() * len(dates) // D.PART_ROWS)  # rows at most
    # merged, not broadcast: Spark would take labels to be as small as the day rows that they are made from
    labels = churn_labels(transactions, dates, label_days, parts).hint("merge").join(real, CID).filter(F.to_date("created_at") < F.col(OBS))
    if min_tenure is not None:
        labels = labels.filter(F.datediff(OBS, F.to_date("created_at")) >= min_tenure)
    spine = labels.withColumn(AS_OF, F.date_sub(OBS, 1))
    as_of = [d - dt.timedelta(1) for d in dates]
    vectors = D.feature_vector(spine, transactions, trusted, semantics, as_of, config, keep=(OBS, "churned"), parts=parts)
    return vectors.withColumnRenamed(AS_OF, "feature_as_of_date")


def time_split(df: DataFrame, test_share: float = 0.2, date: str = OBS, key: str = CID) -> DataFrame:
    """flag the first rows by (date, key) as training rows, at least one row on each side.

    Row counts per date (a few hundred numbers) settle all dates but the one the cut falls into.
    Only that date is ordered by key, over all tasks, to find the key at the cut; the flag is then a comparison, without a
    join. Fewer than two rows and missing dates are refused; (date, key) must be unique.
    """
    by_date = df.groupBy(date).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = sorted((r[date], r["n"]) for r in by_date if r[date] is not None)
    total = sum(n for _, n in counts)
    if len(counts) < len(by_date) or total < 2:
        raise ValueError(f"a split by {date} needs two rows at least and a date in every row; found {total} dated rows")
    cut = min(max(int(total * (1 - test_share)), 1), total - 1)
    before = 0
    for boundary, n in counts:
        if before + n > cut:
            break
        before += n
    ranked = global_position(df.filter(F.col(date) == F.lit(boundary)).select(date, key), [date, key], "_pos")
    first_test = ranked.filter(F.col("_pos") == cut - before).first()[key]
    return df.withColumn("is_train", (F.col(date) < F.lit(boundary)) | ((F.col(date) == F.lit(boundary)) & (F.col(key) < F.lit(first_test))))


def unpivot(df: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """Long form: (feature, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def medians(train: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """exact medians of the training rows, NULL and NaN left out."""
    long = unpivot(train, names).filter(~F.isnan("value"))
    return exact_quantiles(long, "feature", "value", [0.5]).select("feature", F.col("quantile").alias("median"))


def median_impute(df: DataFrame, train: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """missing values replaced by the training medians (one number per feature)."""
    found = {r["feature"]: r["median"] for r in medians(train, names).collect()}
    return df.withColumns({
        n: F.coalesce(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")), F.lit(found.get(n, 0.0))) for n in names
    })


def class_weight(train: DataFrame, label: str = "churned") -> DataFrame:
    """class sizes and the weight of a positive row."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return train.agg(pos.alias("positives"), neg.alias("negatives")).withColumn(
        "scale_pos_weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))
    )


def needs_oversampling(positives: int, negatives: int) -> bool:
    return positives >= 10 and positives / (positives + negatives) < 0.2


def oversample(train: DataFrame, names: tuple[str, ...], label: str = "churned", k: int = 5, seed: int = 42) -> DataFrame:
    """synthetic positives between a positive row and one of its ``k`` nearest positives until classes match.

    Neighbours are exact, by distance over the features as they are, ties by row; see ``functions/neighbours.py``.
    """
    counts = class_weight(train, label).first()
    k = max(min(k, counts["positives"] - 1), 1)
    minority = cut_lineage(train.filter(F.col(label) == 1).select(F.monotonically_increasing_id().alias("_id"), F.array(*[F.col(n).cast("double") for n in names]).alias("x")))
    near = nearest_join(minority, k, "_id", "x")
    theirs = minority.select(F.col("_id").alias("other"), F.col("x").alias("y"))
    listed = near.join(theirs, "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "y"))).alias("ys"))
    neighbours = minority.join(listed.withColumnRenamed("id", "_id"), "_id")
    missing = max(0, counts["negatives"] - counts["positives"])
    whole, rest = divmod(missing, max(counts["positives"], 1))
    # exactly ``rest`` rows, spread by hash, are drawn once more
    turn = global_position(neighbours.select(F.xxhash64("_id", F.lit(seed)).alias("_t"), "_id"), ["_t", "_id"], "_turn").select("_id", "_turn")
    neighbours = neighbours.join(turn, "_id")
    copies = F.lit(whole) + F.when(F.col("_turn") < rest, 1).otherwise(0)
    draws = neighbours.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(1), F.lit(whole + 1)), lambda c: c <= copies)))
    pick = F.element_at("ys", (F.pmod(F.xxhash64("_id", "copy", F.lit(seed + 1)), F.size("ys")) + 1).cast("int"))["y"]
    share = F.pmod(F.xxhash64("_id", "copy", F.lit(seed + 2)), F.lit(1_000_000)) / 1e6
    made = draws.select(F.zip_with("x", pick, lambda a, b: a + (b - a) * share).alias("v"))
    rows = made.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)], F.lit(1).alias(label), F.lit(True).alias("synthetic"))
    return train.select(*[F.col(n).cast("double").alias(n) for n in names], label, F.lit(False).alias("synthetic")).unionByName(rows)


def neutralize(df: DataFrame, names: tuple[str, ...] = NEUTRALIZED_FEATURES) -> DataFrame:
    """context features set to 0 before the model sees them."""
    return df.withColumns({n: F.lit(0.0) for n in names if n in df.columns})


def fit_parts(rows: int, cores: int) -> int:
    """Parts of the rows of a fit: one for each core, or a multiple of that where parts would have over FIT_ROWS rows."""
    return cores * max(1, -(-rows // (cores * FIT_ROWS)))


def train_risk_model(
    train: DataFrame, names: tuple[str, ...] = FEATURE_NAMES, label: str = "churned", trees: int = 100, depth: int = 4, rate: float = 0.1, seed: int = 42
) -> PipelineModel:
    """F8: gradient-boosted trees with the positive class weighted by the class ratio."""
    classes = class_weight(train, label).first()
    ratio = classes["scale_pos_weight"]
    weighted = neutralize(train).withColumn("weight", F.when(F.col(label) == 1, F.lit(float(ratio or 1.0))).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))
    told = GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    # a fit reads its rows some hundred times (as binned blocks, see functions/boosting.py), and each time starts a task for every part
    parts = fit_parts(classes["positives"] + classes["negatives"], train.sparkSession.sparkContext.defaultParallelism)
    rows = cut_lineage(weighted.select(*names, label, "weight").repartition(parts))
    return PipelineModel([VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep"), boosting.fit(rows, names, label, "weight", float(ratio or 1.0), told)])


def model_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probability of the positive class as ``score``."""
    out = model.transform(neutralize(df))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, names: tuple[str, ...] = FEATURE_NAMES) -> list[tuple[str, float]]:
    """importances of the fitted trees, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, (float(v) for v in values)), key=lambda p: (-p[1], p[0]))


@dataclass(frozen=True)
class ModelInfo:
    """Identity of a trained model, stored with every score."""

    version: str
    model_hash: str
    schema_hash: str = feature_schema_hash()


def score_customers(vectors: DataFrame, model: PipelineModel, info: ModelInfo, now: dt.datetime, thresholds: RiskThresholds = RiskThresholds()) -> DataFrame:
    """probability, floor, label and provenance for feature vectors of active customers."""
    D.check_feature_schema(vectors, info.schema_hash)
    kept = vectors.withColumn("features_used", F.array(*FEATURE_NAMES))
    scored = model_scores(model, kept)
    score = risk_floor(F.col("score"), F.col("recency_days"), F.col("tx_count_90d"), F.col("spend_90d"))
    return provenance(scored.withColumn("churn_score", score).withColumn("churn_label", risk_label(F.col("churn_score"), thresholds)), info, now)


def provenance(scored: DataFrame, info: ModelInfo, now: dt.datetime) -> DataFrame:
    """the stored prediction row."""
    at = F.lit(now).cast("timestamp_ntz")
    return scored.select(
        F.sha2(F.concat_ws("|", F.col(CID).cast("string"), F.col(AS_OF).cast("string"), F.lit(info.version)), 256).alias("pred_id"),
        CID, "churn_score", "churn_label", F.lit(info.version).alias("model_version"), AS_OF, at.alias("created_at"), "features_used",
        at.alias("feature_as_of"), F.lit(info.schema_hash).alias("feature_schema_hash"), F.lit(info.model_hash).alias("model_hash"), "trusted_feedback_used",
    )


def score_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("churn_label").agg(F.count(F.lit(1)).alias("customers"), F.avg("churn_score").alias("mean_score"))


def retrained(dataset: DataFrame, trees: int = 100) -> dict:
    """split, impute, balance, and fit the transaction-only and the full model: (model, metrics) of each, and the sizes."""
    rows = cut_lineage(dataset)
    least, found = 10, rows.limit(10).count()
    if found < least:
        raise ValueError(f"retraining takes {least} labelled rows or more, this data set has {found}")
    split = time_split(rows)  # rows are stored already; a flag and a filled value are cheaper than another copy
    filled = median_impute(split, split.filter("is_train"), FEATURE_NAMES)
    train, test = filled.filter("is_train"), filled.filter("NOT is_train")
    classes = class_weight(train).first()
    balanced = needs_oversampling(classes["positives"], classes["negatives"])
    if balanced:  # the weight is taken anew from the balanced rows
        train = cut_lineage(oversample(train, FEATURE_NAMES))
    fits = []
    for names in (BASELINE_FEATURE_NAMES, FEATURE_NAMES):
        model = train_risk_model(train, names, trees=trees)
        fits.append((model, classification_metrics(model_scores(model, test).select(F.col("churned").alias("y"), "score"))))
    return {"models": fits, "train_size": train.count(), "test_size": test.count(), "oversampled": balanced}


def retrain(dataset: DataFrame, trees: int = 100, version: str = "retrained") -> DataFrame:
    """metrics of the transaction-only and the full model side by side; ``stored.retrain_and_store`` keeps them."""
    (_, plain), (_, full) = retrained(dataset, trees)["models"]
    return compare_models(plain, full).withColumn("model_version", F.lit(version))


def ablation_auc(
    train: DataFrame, test: DataFrame, dropped: tuple[str, ...] = ("recency_ratio", "recency_days"), trees: int = 100, full: PipelineModel | None = None
) -> DataFrame:
    """ROC-AUC with and without some features, and the loss in percent. ``full`` is the model on all features where it is fitted already."""
    kept = tuple(n for n in FEATURE_NAMES if n not in dropped)
    models = {"full": full or train_risk_model(train, FEATURE_NAMES, trees=trees), "reduced": train_risk_model(train, kept, trees=trees)}
    parts = [
        classification_metrics(model_scores(model, test).select(F.col("churned").alias("y"), "score")).select(F.lit(label).alias("features"), "roc_auc")
        for label, model in models.items()
    ]
    both = parts[0].unionByName(parts[1])
    return both.agg(*[F.max(F.when(F.col("features") == x, F.col("roc_auc"))).alias(x) for x in ("full", "reduced")]).withColumn("drop_percent", F.try_divide((F.col("full") - F.col("reduced")) * 100, F.col("full")))
