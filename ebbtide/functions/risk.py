"""Column functions for risk scores, labels and work-queue states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.config import RiskThresholds

# Days of silence and the least score they imply.
INACTIVITY_FLOORS = ((180, 0.90), (120, 0.80), (90, 0.65))


def risk_label(score: Column, thresholds: RiskThresholds = RiskThresholds()) -> Column:
    """low, medium or high."""
    return (
        F.when(score < thresholds.medium, F.lit("low"))
        .when(score < thresholds.high, F.lit("medium"))
        .when(score.isNotNull(), F.lit("high"))
    )


def risk_floor(score: Column, recency_days: Column, tx_count: Column, spend: Column) -> Column:
    """F16: long silence without any purchase lifts the score to a floor."""
    silent = (tx_count <= 0) & (spend <= 0)
    floor = F.lit(0.0)
    for days, least in reversed(INACTIVITY_FLOORS):
        floor = F.when(silent & (recency_days >= days), F.lit(least)).otherwise(floor)
    return F.greatest(score, floor)


def urgency(label: Column, recency_days: Column, action_status: Column, critical_after: int = 60) -> Column:
    """Open follow-ups first, then risk and silence."""
    overdue = recency_days.isNull() | (recency_days >= critical_after)
    return (
        F.when(action_status.isin("pending", "in_progress"), F.lit("in_progress"))
        .when((label == "high") & overdue, F.lit("critical"))
        .when(label == "high", F.lit("high"))
        .when(label == "medium", F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def priority_rank(priority: Column) -> Column:
    """Sort key of an action priority."""
    return (
        F.when(priority == "high", 1).when(priority == "medium", 2).when(priority == "low", 3).otherwise(4)
    )


def due_state(due_date: Column, today: Column) -> Column:
    """How far a deadline is away from ``today``."""
    left = F.datediff(due_date, today)
    return (
        F.when(due_date.isNull(), F.lit("none"))
        .when(left < 0, F.lit("overdue"))
        .when(left == 0, F.lit("today"))
        .when(left <= 2, F.lit("soon"))
        .otherwise(F.lit("later"))
    )
