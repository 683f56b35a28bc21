"""Drift view of a model's metric history."""

from pyspark.sql import DataFrame, functions as F

from evenhand.operators.drift import adwin, changepoints, cusum, simple_changepoints, trend
from evenhand.operators.report import series_filter

KEYS = ("model_id", "metric_name")


def drift_view(
    series: DataFrame, model_id: str, now, metrics=("demographic_parity_difference",), days: int = 30
) -> DataFrame:
    """Every drift statistic per metric of one model over the last ``days``."""
    rows = series_filter(series, model_id, now, metrics, days)
    return drift_statistics(rows)


def drift_statistics(series: DataFrame) -> DataFrame:
    """CUSUM, split test, changepoints and trend per (model, metric) history."""
    at, value = "recorded_at", "metric_value"
    day = F.to_date(at)
    cuts = changepoints(series, KEYS, at, value).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("at")).alias("changepoints")
    )
    jumps = simple_changepoints(series, KEYS, at, value).groupBy(*KEYS).agg(
        F.count("changepoint").alias("jumps")
    )
    out = (
        cusum(series, KEYS, at, value, day)
        .join(adwin(series, KEYS, at, value, day).drop("points"), list(KEYS))
        .join(trend(series, KEYS, at, value), list(KEYS))
        .join(cuts, list(KEYS), "left")
        .join(jumps, list(KEYS), "left")
    )
    none = F.array().cast("array<timestamp>")
    return out.withColumn("changepoints", F.coalesce("changepoints", none)).na.fill({"jumps": 0})
