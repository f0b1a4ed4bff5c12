"""Point-in-time customer features, one row per customer and as-of date (D operators).

Facts are first reduced to one row per customer and calendar day, which Spark combines on the
map side, so a customer owning a third of the facts shrinks to a few thousand rows before any
shuffle. Every later step works on those day rows: windows are conditional sums after each day
row is copied only to the as-of dates whose look-back holds it, and life-time values are running
sums whose rows are valid from one active day to the next. No range join, no cross join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.config import (
    FEATURE_NAMES,
    FEATURE_SCHEMA_VERSION,
    NEVER_BOUGHT_RECENCY,
    TRUSTED_STATUSES,
    FeatureConfig,
    feature_schema_hash,
)
from ebbtide.functions import series as S
from ebbtide.functions.skew import top_n

Dates = list[dt.date]
CID, AS_OF = "customer_id", "as_of_date"
#: Rows of customers and dates in a part, some 100 MB where they are summed or joined.
PART_ROWS = 250_000


# ---------------------------------------------------------------------------------------------
# Anchors, spine and day rows
# ---------------------------------------------------------------------------------------------
def default_as_of_date(transactions: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """The newest completed transaction or message date, as one row."""
    newest = transactions.filter(F.col("status") == "completed").select(F.to_date("tx_date").alias("d"))
    if messages is not None:
        newest = newest.unionByName(messages.select(F.to_date("timestamp").alias("d")))
    return newest.agg(F.max("d").alias(AS_OF))


def anchor_date(transactions: DataFrame, messages: DataFrame | None = None) -> dt.date:
    """B13 as a value, so that date filters become literals the parquet scan can use."""
    return default_as_of_date(transactions, messages).first()[AS_OF]


def date_array(dates: Dates) -> Column:
    return F.array(*[F.lit(d) for d in sorted(set(dates))])


def customer_spine(customers: DataFrame, dates: Dates) -> DataFrame:
    """One row per customer and as-of date; a frame that already has the date column is taken as the spine."""
    if AS_OF in customers.columns:
        return customers
    return customers.withColumn(AS_OF, F.explode(date_array(dates)))


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt by customer and as-of date, in ``parts`` parts, or one for each core where that is more.

    Copies for many dates come out of day rows, which lie in few parts as they are small; what is made of the copies would lie in as few.
    """
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), CID, AS_OF) if parts else rows.repartition(CID, AS_OF)


def daily_transactions(transactions: DataFrame, until: dt.date | None = None) -> DataFrame:
    """Completed transactions per customer and day: count, spend, first and last time.

    Money has two decimals and is summed as whole cents: exact in any order and faster than wide decimals.
    """
    done = transactions.filter(F.col("status") == "completed")
    if until is not None:
        done = done.filter(F.col("tx_date") < F.lit(dt.datetime.combine(until + dt.timedelta(1), dt.time())).cast("timestamp_ntz"))
    return done.groupBy(CID, F.to_date("tx_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("amount") * 100).cast("bigint")).alias("cents"),
        F.min("tx_date").alias("first_ts"),
        F.max("tx_date").alias("last_ts"),
    )


def trusted_messages(
    messages: DataFrame, links: DataFrame, features: DataFrame, statuses: tuple[str, ...] = TRUSTED_STATUSES
) -> DataFrame:
    """Raw message, link and extracted signals of trusted links, joined on their unique ids.

    Messages come first: a filter on ``timestamp`` above (see :func:`recent`) reaches their scan, and only the
    messages left go into the second join.
    """
    return (
        messages.select("msg_id", "timestamp")
        .join(features.select("link_id", "msg_id", "has_complaint", "msg_length", "response_time_secs"), "msg_id")
        .join(links.filter(F.col("link_status").isin(*statuses)).select("link_id", CID), "link_id")
        .select("msg_id", "link_id", "has_complaint", "msg_length", "response_time_secs", CID, "timestamp")
    )


def recent(trusted: DataFrame, dates: Dates, days: int) -> DataFrame:
    """Messages that any of the dates can see, by literal bounds on the message time."""
    first, last = min(dates) - dt.timedelta(days), max(dates) + dt.timedelta(1)
    at = lambda d: F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")
    return trusted.filter((F.col("timestamp") >= at(first)) & (F.col("timestamp") < at(last)))


def daily_messages(trusted: DataFrame) -> DataFrame:
    """Trusted messages per customer and day, with the sums every text signal needs."""
    nonzero_len = F.when(F.col("msg_length") != 0, F.col("msg_length"))
    nonzero_delay = F.when(F.col("response_time_secs") != 0, F.col("response_time_secs"))
    return trusted.groupBy(CID, F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_complaint").alias("complaints"),
        F.sum(nonzero_len.cast("bigint")).alias("len_sum"),
        F.count(nonzero_len).alias("len_n"),
        F.sum(nonzero_delay.cast("bigint")).alias("delay_sum"),
        F.count(nonzero_delay).alias("delay_n"),
        F.count("response_time_secs").alias("delay_all_n"),
    )


def _days_before(days: int) -> Column:
    return F.date_sub(F.col(AS_OF), days)


def _fan_out(daily: DataFrame, dates: Dates, lookback: int) -> DataFrame:
    """Copy each day row to the as-of dates whose look-back (inclusive) contains the day."""
    hit = F.filter(date_array(dates), lambda a: (F.col("day") <= a) & (F.col("day") >= F.date_sub(a, lookback)))
    return daily.withColumn(AS_OF, F.explode(hit))


def _valid_at(rows: DataFrame, day: str, dates: Dates, lag_days: int = 0) -> DataFrame:
    """As-of lookup: keep, per customer and as-of date, the newest row not after the date.

    Rows of one customer are valid from their day to the day before the next row; each as-of
    date (minus ``lag_days``) falls into at most one such interval.
    """
    following = F.lead(day).over(Window.partitionBy(CID).orderBy(day))
    cut = rows.withColumn("_next", following)

    def inside(a: Column) -> Column:
        at = F.date_sub(a, lag_days)
        return (F.col(day) <= at) & (F.col("_next").isNull() | (at < F.col("_next")))

    return cut.withColumn(AS_OF, F.explode(F.filter(date_array(dates), inside))).drop("_next")


# ---------------------------------------------------------------------------------------------
# Transactions
# ---------------------------------------------------------------------------------------------
def _window_edges(index: int, config: FeatureConfig) -> tuple[int, int]:
    """Days before the as-of date at which window ``index`` (0 = oldest) starts and ends."""
    end = (config.activity_windows - 1 - index) * config.window_size_days
    return end + config.window_size_days, end


def in_window(index: int, config: FeatureConfig, bounds: str) -> Column:
    """``inclusive``: both edge days belong (neighbours share one); ``half_open``: [start, end)."""
    start, end = _window_edges(index, config)
    last = F.col("day") <= _days_before(end) if bounds == "inclusive" else F.col("day") < _days_before(end)
    return (F.col("day") >= _days_before(start)) & last


def windowed_series(
    daily: DataFrame, dates: Dates, config: FeatureConfig, values: dict[str, str], bounds: str = "inclusive"
) -> DataFrame:
    """Per customer and as-of date, one array per entry of ``values`` ({output: day column})."""
    fanned = _fan_out(daily, dates, config.lookback_days)
    aggs = [
        F.coalesce(F.sum(F.when(in_window(i, config, bounds), F.col(source))).cast("double"), F.lit(0.0)).alias(f"_{out}_{i}")
        for out, source in values.items()
        for i in range(config.activity_windows)
    ]
    wide = fanned.groupBy(CID, AS_OF).agg(*aggs)
    arrays = [F.array(*[f"_{out}_{i}" for i in range(config.activity_windows)]).alias(out) for out in values]
    return wide.select(CID, AS_OF, *arrays)



def purchase_windows(daily: DataFrame, dates: Dates, config: FeatureConfig, bounds: str = "inclusive", wide_days: int = 90, parts: int | None = None) -> DataFrame:
    """Look-back sums (D1, D4) and life-time values (recency, D12) per customer and as-of date, in one pass.

    A day row goes to the as-of dates whose look-back holds the day and to those it is the newest
    purchase day of. Gaps between purchases count whole elapsed 24 h blocks: two purchases on one
    day are less than a block apart, so only the gap from the last time of one active day to the
    first of the next can count, and running sums over active days give the mean gap.
    """
    w = Window.partitionBy(CID).orderBy("day")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        daily.withColumns({"_prev_ts": F.lag("last_ts").over(w), "_next": F.lead("day").over(w)})
        .withColumn("_gap", F.coalesce(F.expr("extract(DAY FROM (first_ts - _prev_ts))"), F.lit(0)))
        .select(CID, "day", "n", "cents", "_next", F.sum("_gap").over(running).alias("_gaps"), F.sum("n").over(running).alias("_buys"))
    )
    lookback = max(wide_days, config.lookback_days)

    def wanted(a: Column) -> Column:
        recent = F.col("day") >= F.date_sub(a, lookback)
        return (F.col("day") <= a) & (recent | F.col("_next").isNull() | (a < F.col("_next")))

    fanned = dealt(rows.withColumn(AS_OF, F.explode(F.filter(date_array(dates), wanted))), parts)
    newest = F.col("_next").isNull() | (F.col(AS_OF) < F.col("_next"))
    aggs = [F.max(F.when(newest, F.col(c))).alias(out) for c, out in (("day", "last_tx_day"), ("_gaps", "gap_days"), ("_buys", "purchases"))]
    for days in sorted({30, wide_days}):
        recent = F.col("day") >= _days_before(days)
        aggs += [F.sum(F.when(recent, F.col("n"))).alias(f"tx_count_{days}"), (F.sum(F.when(recent, F.col("cents"))) / 100.0).alias(f"spend_{days}")]
    for i in range(config.activity_windows):
        hit = in_window(i, config, bounds)
        aggs += [F.sum(F.when(hit, F.col("n"))).cast("double").alias(f"_n_{i}"), (F.sum(F.when(hit, F.col("cents"))) / 100.0).alias(f"_s_{i}")]
    return fanned.groupBy(CID, AS_OF).agg(*aggs)


def _numeric_columns(config: FeatureConfig, wide_days: int) -> dict[str, Column]:
    """D1 columns over a spine left-joined to :func:`purchase_windows`."""
    count_w, spend_w = F.coalesce(f"tx_count_{wide_days}", F.lit(0)), F.coalesce(f"spend_{wide_days}", F.lit(0.0))
    gap = F.try_divide(F.col("gap_days").cast("double"), F.col("purchases") - 1)
    span = range(config.activity_windows)
    return {
        "recency_days": F.coalesce(F.datediff(AS_OF, "last_tx_day"), F.lit(NEVER_BOUGHT_RECENCY)),
        "tx_count_30d": F.coalesce("tx_count_30", F.lit(0)),
        "tx_count_90d": count_w,
        "spend_30d": F.coalesce("spend_30", F.lit(0.0)),
        "spend_90d": spend_w,
        "avg_tx_value": F.coalesce(F.try_divide(spend_w, count_w.cast("double")), F.lit(0.0)),
        "tenure_days": F.coalesce(F.greatest(F.datediff(AS_OF, F.to_date("created_at")), F.lit(0)), F.lit(0)),
        "avg_interpurchase_days": F.coalesce(gap, F.lit(0.0)),
        "tx_series": F.array(*[F.coalesce(f"_n_{i}", F.lit(0.0)) for i in span]),
        "spend_series": F.array(*[F.coalesce(f"_s_{i}", F.lit(0.0)) for i in span]),
    }


def numeric_features(
    customers: DataFrame, transactions: DataFrame, dates: Dates, config: FeatureConfig = FeatureConfig(), wide_days: int = 90
) -> DataFrame:
    """Recency, 30/90-day counts and spend, mean value and tenure; plus the series for D4-D12."""
    daily = daily_transactions(transactions, max(dates))
    spine = customer_spine(customers, dates).select(CID, AS_OF, "created_at")
    joined = spine.join(purchase_windows(daily, dates, config, wide_days=wide_days), [CID, AS_OF], "left")
    return joined.select(CID, AS_OF, *[c.alias(n) for n, c in _numeric_columns(config, wide_days).items()])


def rfm_columns() -> dict[str, Column]:
    """Recency, frequency and spend mapped to 0..5, two decimals."""
    return {
        "r_score": F.round(F.greatest(F.lit(0.0), 5.0 - F.col("recency_days") / 36.0), 2),
        "f_score": F.round(F.least(F.lit(5.0), F.col("tx_count_90d") / F.lit(2.0)), 2),
        "m_score": F.round(F.least(F.lit(5.0), F.col("spend_90d") / F.lit(1_000_000.0)), 2),
    }


def rfm_scores(numeric: DataFrame) -> DataFrame:
    return numeric.select(CID, AS_OF, *[c.alias(n) for n, c in rfm_columns().items()])


# ---------------------------------------------------------------------------------------------
# Messages
# ---------------------------------------------------------------------------------------------
def _calendar_std(total: Column, squares: Column, days: Column) -> Column:
    """Population std of daily counts over ``days`` days from whole-number sums (days without rows are 0)."""
    return F.sqrt((days * squares - total * total).cast("double")) / days


def msg_volatility(daily: DataFrame, dates: Dates, mode: str = "calendar", days: int = 30) -> DataFrame:
    """Std of daily message counts; ``calendar`` counts every day of [as_of - days, as_of],
    ``active`` only days with messages, ``training`` every day of [as_of - days, as_of - 1]."""
    fanned = _fan_out(daily, dates, days)
    if mode == "training":
        fanned = fanned.filter(F.col("day") < F.col(AS_OF))
    sums = fanned.groupBy(CID, AS_OF).agg(
        F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.count(F.lit(1)).alias("k")
    )
    span = {"calendar": F.lit(days + 1), "active": F.col("k"), "training": F.lit(days)}[mode]
    return sums.select(CID, AS_OF, _calendar_std(F.col("s"), F.col("ss"), span).alias("msg_volatility"))


def message_windows(daily: DataFrame, dates: Dates, days: int = 30, config: FeatureConfig | None = None, parts: int | None = None) -> DataFrame:
    """Sums behind the text signals of the last ``days`` days and, with ``config``, the window counts, in one pass."""
    fanned = dealt(_fan_out(daily, dates, max(days, config.lookback_days) if config else days), parts)
    recent = F.col("day") >= _days_before(days)

    def recent_sum(column: Column | str) -> Column:
        return F.sum(F.when(recent, F.col(column) if isinstance(column, str) else column))

    aggs = [recent_sum(c).alias(c) for c in ("n", "complaints", "len_sum", "len_n", "delay_sum", "delay_n", "delay_all_n")]
    aggs += [
        F.sum(F.when(F.col("day") >= _days_before(7), F.col("n"))).alias("n7"),
        recent_sum(F.col("n") * F.col("n")).alias("squares"),
        F.count_if(recent).alias("active_days"),
    ]
    if config:
        aggs += [F.sum(F.when(in_window(i, config, "inclusive"), F.col("n"))).cast("double").alias(f"_m_{i}") for i in range(config.activity_windows)]
    return fanned.groupBy(CID, AS_OF).agg(*aggs)


def _signal_columns(days: int, volatility: str, delay_ignores_zero: bool = True) -> dict[str, Column]:
    """D3 columns over a spine left-joined to :func:`message_windows`."""
    def mean(top: str, under: str) -> Column:
        return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(under).cast("double")), F.lit(0.0))

    span = F.lit(days + 1) if volatility == "calendar" else F.nullif("active_days", F.lit(0))
    return {
        "msg_count_7d": F.coalesce("n7", F.lit(0)),
        "msg_count_30d": F.coalesce("n", F.lit(0)),
        "complaint_rate_30d": mean("complaints", "n"),
        "avg_msg_length_30d": mean("len_sum", "len_n"),
        "response_delay_mean": mean("delay_sum", "delay_n" if delay_ignores_zero else "delay_all_n"),
        "msg_volatility": F.coalesce(_calendar_std(F.col("n"), F.col("squares"), span), F.lit(0.0)),
    }


def text_signals(
    customers: DataFrame, trusted: DataFrame, dates: Dates, days: int = 30, volatility: str = "calendar",
    delay_ignores_zero: bool = True,
) -> DataFrame:
    """D3: message counts, complaint rate, mean length, mean reply delay and volatility."""
    spine = customer_spine(customers, dates).select(CID, AS_OF)
    joined = spine.join(message_windows(daily_messages(recent(trusted, dates, days)), dates, days), [CID, AS_OF], "left")
    return joined.select(CID, AS_OF, *[c.alias(n) for n, c in _signal_columns(days, volatility, delay_ignores_zero).items()])


def _sentiment_parts(semantics: DataFrame, dates: Dates, prior_days: int, current_as_of: bool) -> tuple[DataFrame, DataFrame]:
    """Current and prior score per customer and as-of date, as columns ``_now`` and ``_prior``."""
    scores = semantics.filter(F.col(AS_OF) <= F.lit(max(dates))).select(CID, F.col(AS_OF).alias("snap"), "avg_sentiment_score")
    prior = _valid_at(scores, "snap", dates, prior_days).select(CID, AS_OF, F.col("avg_sentiment_score").alias("_prior"))
    if current_as_of:
        current = _valid_at(scores, "snap", dates).select(CID, AS_OF, F.col("avg_sentiment_score").alias("_now"))
    else:
        wanted = [F.lit(d) for d in sorted(set(dates))]
        current = scores.filter(F.col("snap").isin(*wanted)).select(CID, F.col("snap").alias(AS_OF), F.col("avg_sentiment_score").alias("_now"))
    return current, prior


def _sentiment_columns() -> dict[str, Column]:
    now = F.coalesce("_now", F.lit(0.0))
    before = F.when(F.col("_now").isNotNull(), F.coalesce("_prior", F.lit(0.0))).otherwise(F.lit(0.0))
    return {"avg_sentiment_score": now, "sentiment_trend": now - before}


def sentiment_features(spine: DataFrame, semantics: DataFrame, dates: Dates, prior_days: int = 30, current_as_of: bool = False) -> DataFrame:
    """Score of the exact as-of snapshot and its change against the newest one ``prior_days`` back.

    A prior snapshot without a score counts as 0; nothing older is consulted. With
    ``current_as_of`` the current score is looked up as-of as well (training variant).
    """
    current, prior = _sentiment_parts(semantics, dates, prior_days, current_as_of)
    joined = spine.select(CID, AS_OF).join(current, [CID, AS_OF], "left").join(prior, [CID, AS_OF], "left")
    return joined.select(CID, AS_OF, *[c.alias(n) for n, c in _sentiment_columns().items()])


def live_sentiment_windows(scored_messages: DataFrame, as_of: dt.date, days: int = 30, cap: int = 20) -> DataFrame:
    """Mean score of up to ``cap`` newest inbound messages in the current and the prior window.

    The windows share their edge day, as the windows of D4 do.
    """
    day = F.to_date("timestamp")
    edge, oldest = as_of - dt.timedelta(days), as_of - dt.timedelta(2 * days)
    tagged = (
        scored_messages.filter((F.col("direction") == "inbound") & (day <= F.lit(as_of)) & (day >= F.lit(oldest)))
        .withColumn("part", F.explode(F.filter(
            F.array(F.when(day >= F.lit(edge), F.lit("now")), F.when(day <= F.lit(edge), F.lit("prior"))),
            lambda p: p.isNotNull(),
        )))
    )
    newest = top_n(tagged, [CID, "part"], [F.desc("timestamp"), F.desc("msg_id")], cap)
    return newest.groupBy(CID).agg(
        F.coalesce(F.avg(F.when(F.col("part") == "now", F.col("score"))), F.lit(0.0)).alias("avg_current"),
        F.coalesce(F.avg(F.when(F.col("part") == "prior", F.col("score"))), F.lit(0.0)).alias("avg_prior"),
    )


# ---------------------------------------------------------------------------------------------
# The 20-feature vector
# ---------------------------------------------------------------------------------------------
def window_items(series: str, config: FeatureConfig) -> list[Column]:
    return [F.col(series)[i] for i in range(config.activity_windows)]


def derived_features(base: DataFrame, config: FeatureConfig) -> DataFrame:
    """Trends, magnitude, volatility, ratio and interaction from the window series.

    The number of windows is fixed by the configuration, so everything is plain arithmetic on
    window columns. Means and deviations become columns before they are used again, which keeps
    each generated method small and every value computed once.
    """
    tx, spend = window_items("tx_series", config), window_items("spend_series", config)
    first = base.withColumns({
        "recency_ratio": S.safe_ratio(F.col("recency_days").cast("double"), F.col("avg_interpurchase_days"), config),
        "frequency_trend_smoothed": S.slope_of(S.smooth_of(tx, config)),
        "spend_trend_smoothed": S.slope_of(S.smooth_of(spend, config)),
        "activity_mean": S.mean_of(tx),
        "spend_mean": S.mean_of(spend),
        "recent_activity_avg": tx[-1],
    })
    second = first.withColumns({
        "activity_std": S.std_of(tx, F.col("activity_mean")),
        "spend_std": S.std_of(spend, F.col("spend_mean")),
        "trend_magnitude_interaction": F.col("frequency_trend_smoothed") * F.col("activity_mean"),
    })
    return second.withColumns({
        "activity_cv": S.capped_cv_of(F.col("activity_std"), F.col("activity_mean"), config),
        "spend_volatility_cv": S.capped_cv_of(F.col("spend_std"), F.col("spend_mean"), config),
    }).drop("spend_mean", "spend_std")


def feature_vector(
    customers: DataFrame, transactions: DataFrame, trusted: DataFrame, semantics: DataFrame, dates: Dates,
    config: FeatureConfig = FeatureConfig(), mode: str = "persisted", prior_days: int = 30, keep: tuple[str, ...] = (), parts: int | None = None,
) -> DataFrame:
    """The 20 features in schema order per customer and as-of date, plus the spine columns in ``keep``.

    ``persisted`` uses the fixed 30/90-day look-backs and the calendar volatility; ``verified``
    ties the look-back and the text window to ``config`` and uses active-day volatility. One spine
    is joined to one aggregate of purchases, one of messages and two of sentiment snapshots, all
    on the same keys. ``parts`` is the number of parts that the joined rows are dealt over (see :func:`dealt`).
    """
    joined = dealt(customer_spine(customers, dates).select(CID, AS_OF, "created_at", *keep), parts)
    for part in vector_inputs(transactions, trusted, semantics, dates, config, mode, prior_days, parts).values():
        joined = joined.join(part, [CID, AS_OF], "left")
    return assembled_vector(joined, config, mode, keep)


def _look_back(config: FeatureConfig, mode: str) -> tuple[int, int]:
    """Days of purchases and of messages that the fixed look-back features see."""
    return (config.lookback_days, config.window_size_days) if mode == "verified" else (90, 30)


def vector_inputs(
    transactions: DataFrame, trusted: DataFrame, semantics: DataFrame, dates: Dates, config: FeatureConfig = FeatureConfig(), mode: str = "persisted", prior_days: int = 30,
    parts: int | None = None,
) -> dict[str, DataFrame]:
    """What a feature vector is made of besides its spine, a row per customer and as-of date each."""
    wide_days, text_days = _look_back(config, mode)
    current, prior = _sentiment_parts(semantics, dates, prior_days, False)
    return {
        "purchases": purchase_windows(daily_transactions(transactions, max(dates)), dates, config, wide_days=wide_days, parts=parts),
        "messages": message_windows(daily_messages(recent(trusted, dates, max(text_days, config.lookback_days))), dates, text_days, config, parts),
        "mood_now": current,
        "mood_before": prior,
    }


def assembled_vector(joined: DataFrame, config: FeatureConfig, mode: str = "persisted", keep: tuple[str, ...] = ()) -> DataFrame:
    """The 20 features from a spine joined with its inputs."""
    verified = mode == "verified"
    wide_days, text_days = _look_back(config, mode)
    columns = _numeric_columns(config, wide_days) | _signal_columns(text_days, "active" if verified else "calendar") | _sentiment_columns()
    messages = [F.coalesce(f"_m_{i}", F.lit(0.0)) for i in range(config.activity_windows)]
    columns["msg_trend_smoothed"] = S.slope_of(S.smooth_of(messages, config))
    base = joined.select(CID, AS_OF, *keep, *[c.alias(n) for n, c in columns.items()])
    full = derived_features(base, config).withColumnRenamed("complaint_rate_30d", "complaint_ratio")
    return full.select(
        CID, AS_OF, *keep,
        *[F.col(name).cast("double").alias(name) for name in FEATURE_NAMES],
        F.col("msg_count_30d").alias("trusted_feedback_used"),
    )


def with_metadata(vectors: DataFrame, config: FeatureConfig) -> DataFrame:
    """The schema and window columns stored next to a feature vector."""
    return vectors.withColumns({
        "feature_schema_hash": F.lit(feature_schema_hash()),
        "feature_service_version": F.lit(FEATURE_SCHEMA_VERSION),
        "feature_window_days": F.lit(config.window_size_days),
    })


def check_feature_schema(vectors: DataFrame, expected_hash: str | None = None) -> DataFrame:
    """Fail the job at plan time when names, order or hash differ from the declared schema."""
    found = tuple(c for c in vectors.columns if c in FEATURE_NAMES)
    if found != FEATURE_NAMES:
        raise ValueError(f"feature columns {found} differ from the declared schema")
    if expected_hash is not None and expected_hash != feature_schema_hash(found):
        raise ValueError("feature schema hash mismatch")
    return vectors


def score_range_violations(scores: DataFrame, column: str = "churn_score") -> DataFrame:
    """Scores outside [0, 1] or missing."""
    return scores.filter(F.col(column).isNull() | ~F.col(column).between(0, 1))


def trust_gate(customers: DataFrame, links: DataFrame, as_of: dt.datetime, statuses: tuple[str, ...] = TRUSTED_STATUSES) -> DataFrame:
    """Trusted and total link counts per customer and whether features may be built."""
    known = F.col("linked_at") <= F.lit(as_of).cast("timestamp_ntz")
    counts = links.groupBy(CID).agg(
        F.count_if(F.col("link_status").isin(*statuses) & known).alias("trusted"), F.count(F.lit(1)).alias("total")
    )
    return customers.select(CID).join(counts, CID, "left").select(
        CID,
        F.coalesce("trusted", F.lit(0)).alias("trusted_count"),
        F.coalesce("total", F.lit(0)).alias("total_count"),
        (F.coalesce("trusted", F.lit(0)) > 0).alias("eligible"),
    )


def eligible_customers(customers: DataFrame, links: DataFrame, as_of: dt.datetime, statuses: tuple[str, ...] = TRUSTED_STATUSES) -> DataFrame:
    """Customers with a trusted link known at ``as_of``; verified scoring takes no others."""
    known = links.filter(F.col("link_status").isin(*statuses) & (F.col("linked_at") <= F.lit(as_of).cast("timestamp_ntz")))
    return customers.join(known.select(CID), CID, "left_semi")


def snapshot_counters(snapshot: DataFrame) -> DataFrame:
    """Customers in a snapshot, with all features, and with a missing one."""
    return snapshot.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("complete").alias("processed"), F.count_if(~F.col("complete")).alias("missing")
    )


def feature_snapshot(
    customers: DataFrame, transactions: DataFrame, trusted: DataFrame, semantics: DataFrame, as_of: dt.date,
    config: FeatureConfig = FeatureConfig(), prior_days: int = 30,
) -> DataFrame:
    """The snapshot rows of all active customers at one date, with a completeness flag."""
    active = customers.filter("is_active")
    vectors = feature_vector(active, transactions, trusted, semantics, [as_of], config, prior_days=prior_days)
    any_null = F.lit(False)
    for name in FEATURE_NAMES:
        any_null = any_null | F.col(name).isNull()
    return check_feature_schema(with_metadata(vectors, config)).withColumn("complete", ~any_null)
