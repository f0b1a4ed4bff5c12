"""Parameters of the feature layer and the fixed, ordered feature schema."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass

TRUSTED_STATUSES = ("verified", "probable")
MIN_LINK_CONFIDENCE = 0.7
NEVER_BOUGHT_RECENCY = 999

# Feature names in model order.
FEATURE_NAMES = (
    "recency_ratio",
    "frequency_trend_smoothed",
    "spend_trend_smoothed",
    "msg_trend_smoothed",
    "sentiment_trend",
    "recency_days",
    "tx_count_90d",
    "spend_90d",
    "avg_tx_value",
    "tenure_days",
    "activity_mean",
    "recent_activity_avg",
    "activity_std",
    "activity_cv",
    "spend_volatility_cv",
    "trend_magnitude_interaction",
    "avg_sentiment_score",
    "complaint_ratio",
    "msg_volatility",
    "response_delay_mean",
)
FEATURE_SCHEMA_VERSION = "v3.0.0"
# Features that need messages; the transaction-only baseline model leaves them out.
MESSAGE_FEATURES = (
    "msg_trend_smoothed",
    "sentiment_trend",
    "avg_sentiment_score",
    "complaint_ratio",
    "msg_volatility",
    "response_delay_mean",
)
BASELINE_FEATURE_NAMES = tuple(n for n in FEATURE_NAMES if n not in MESSAGE_FEATURES)
NEUTRALIZED_FEATURES = ("tenure_days",)


def feature_schema_hash(names: tuple[str, ...] = FEATURE_NAMES) -> str:
    """First 16 hex digits of the SHA-256 of the JSON list of (name, type) pairs."""
    text = json.dumps([[name, "numeric"] for name in names], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class FeatureConfig:
    """Feature parameters; checked when built, unknown keys ignored by :meth:`from_dict`."""

    smoothing_method: str = "sma"
    smoothing_window: int = 3
    ema_alpha: float | None = None
    activity_windows: int = 3
    window_size_days: int = 30
    min_activity_threshold: float = 0.01
    cv_cap: float = 10.0
    ratio_cap: float = 10.0
    ratio_default: float = 1.0
    schema_version: str = FEATURE_SCHEMA_VERSION

    def __post_init__(self) -> None:
        problems = []
        if self.smoothing_method not in ("sma", "ema"):
            problems.append(f"smoothing_method {self.smoothing_method!r} is neither sma nor ema")
        for name, least in (("smoothing_window", 1), ("activity_windows", 2), ("window_size_days", 1), ("min_activity_threshold", 0)):
            if getattr(self, name) < least:
                problems.append(f"{name} must be at least {least}")
        if self.ema_alpha is not None and not 0 < self.ema_alpha <= 1:
            problems.append("ema_alpha must lie in (0, 1]")
        if problems:
            raise ValueError("; ".join(problems))

    @classmethod
    def from_dict(cls, values: dict) -> "FeatureConfig":
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    @property
    def alpha(self) -> float:
        return self.ema_alpha if self.ema_alpha is not None else 2.0 / (self.smoothing_window + 1)

    @property
    def lookback_days(self) -> int:
        return self.activity_windows * self.window_size_days


@dataclass(frozen=True)
class RiskThresholds:
    """Score cuts between low, medium and high."""

    medium: float = 0.40
    high: float = 0.90
