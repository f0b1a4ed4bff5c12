"""Column functions over short arrays of window values (oldest first) and scalar ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.config import FeatureConfig


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    """Mean, 0 for an empty array."""
    return F.coalesce(F.try_divide(array_sum(values), F.size(values).cast("double")), F.lit(0.0))


def sma(values: Column, window: int) -> Column:
    """Trailing mean of up to ``window`` points; the head uses what exists."""
    return F.transform(
        values,
        lambda _, i: array_mean(
            F.slice(values, F.greatest(i - F.lit(window - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(window)))
        ),
    )


def ema(values: Column, alpha: float) -> Column:
    """Exponential mean seeded with the first value."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) == 0, values).otherwise(
        F.aggregate(
            rest,
            F.slice(values, 1, 1),
            lambda acc, x: F.concat(acc, F.array(x * alpha + F.element_at(acc, -1) * (1 - alpha))),
        )
    )


def smooth(values: Column, config: FeatureConfig) -> Column:
    """The configured smoother; one point or none passes unchanged."""
    smoothed = ema(values, config.alpha) if config.smoothing_method == "ema" else sma(values, config.smoothing_window)
    return F.when(F.size(values) <= 1, values).otherwise(smoothed)


def trend_slope(values: Column) -> Column:
    """Least-squares slope on the index, 0 below two points.

    The index is centred, so the sum of ``(t - mean) * y`` over the sum of squares is the slope.
    """
    n = F.size(values).cast("double")
    centre = (n - 1) / 2
    top = array_sum(F.transform(values, lambda y, i: (i - centre) * y))
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(F.try_divide(top, n * (n * n - 1) / 12))


def std_pop(values: Column) -> Column:
    mean = array_mean(values)
    spread = F.aggregate(
        values, F.struct(F.lit(0.0).alias("s"), mean.alias("m")),
        lambda acc, x: F.struct((acc["s"] + (x - acc["m"]) * (x - acc["m"])).alias("s"), acc["m"].alias("m")),
        lambda acc: acc["s"],
    )
    return F.when(F.size(values) < 2, F.lit(0.0)).otherwise(F.sqrt(spread / F.size(values)))


def capped_cv(values: Column, config: FeatureConfig) -> Column:
    """Std over mean, capped; 0 for dormant series."""
    mean = array_mean(values)
    return F.when(
        (F.size(values) >= 2) & (mean >= config.min_activity_threshold),
        F.least(F.lit(config.cv_cap), F.try_divide(std_pop(values), mean)),
    ).otherwise(F.lit(0.0))


def safe_ratio(current: Column, prior: Column, config: FeatureConfig) -> Column:
    """0/0 gives the default, x/0 the cap, else the capped quotient."""
    return (
        F.when((prior == 0) & (current == 0), F.lit(config.ratio_default))
        .when(prior == 0, F.lit(config.ratio_cap))
        .otherwise(F.least(F.lit(config.ratio_cap), F.try_divide(current, prior)))
    )


# ---------------------------------------------------------------------------------------------
# The same on a fixed number of window columns: plain arithmetic that stays in generated code
# ---------------------------------------------------------------------------------------------
def total_of(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def mean_of(values: list[Column]) -> Column:
    return total_of(values) / float(len(values))


def smooth_of(values: list[Column], config: FeatureConfig) -> list[Column]:
    """D18 on window columns (oldest first)."""
    if len(values) <= 1:
        return list(values)
    if config.smoothing_method == "ema":
        out = [values[0]]
        for v in values[1:]:
            out.append(v * config.alpha + out[-1] * (1 - config.alpha))
        return out
    w = config.smoothing_window
    return [mean_of(values[max(0, i - w + 1) : i + 1]) for i in range(len(values))]


def slope_of(values: list[Column]) -> Column:
    """D8 on window columns: weights are the centred positions."""
    n = len(values)
    if n < 2:
        return F.lit(0.0)
    weighted = [v * (i - (n - 1) / 2) for i, v in enumerate(values) if i != (n - 1) / 2]
    return total_of(weighted) / (n * (n * n - 1) / 12)


def std_of(values: list[Column], mean: Column) -> Column:
    """Population std of window columns around their mean."""
    if len(values) < 2:
        return F.lit(0.0)
    return F.sqrt(mean_of([F.pow(v - mean, F.lit(2.0)) for v in values]))


def capped_cv_of(std: Column, mean: Column, config: FeatureConfig) -> Column:
    """D10 from std and mean."""
    return F.when(mean >= config.min_activity_threshold, F.least(F.lit(config.cv_cap), F.try_divide(std, mean))).otherwise(F.lit(0.0))
