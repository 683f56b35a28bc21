"""Dashboard views over the audits, predictions and mitigation tables."""

from pyspark.sql import DataFrame, functions as F

from evenhand.operators.report import metric_rows, metric_value, slice_rows
from evenhand.operators.severity import severity_gauge, severity_rank


def staged_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions with parsed labels and the day, one row per event."""
    return predictions.select(
        "event_id",
        "model_id",
        "model_version",
        "timestamp",
        F.to_date("timestamp").alias("day"),
        F.expr("try_cast(prediction_label AS int)").alias("prediction_label"),
        "prediction_score",
        F.expr("try_cast(ground_truth AS int)").alias("ground_truth"),
        "tenant_id",
        "use_case",
    )


def staged_audits(audits: DataFrame) -> DataFrame:
    """Audits with day, gauge number and count of breached metrics."""
    return audits.select(
        "audit_id",
        "model_id",
        "model_version",
        "audit_timestamp",
        F.to_date("audit_timestamp").alias("day"),
        "sample_size",
        "overall_severity",
        severity_gauge("overall_severity").alias("severity_level"),
        "metrics",
    )


def scorecard(audits: DataFrame) -> DataFrame:
    """Latest audit per model with its gauge number."""
    kept = F.struct("audit_id", "audit_timestamp", "overall_severity", "sample_size")
    latest = audits.groupBy("model_id").agg(
        F.max_by(kept, F.struct("audit_timestamp", "audit_id")).alias("r")
    )
    return latest.select("model_id", "r.*").withColumn(
        "severity_level", severity_gauge("overall_severity")
    )


def metric_trend(audits: DataFrame, metric: str, reference: float | None = None) -> DataFrame:
    """One metric over audit time, with an optional reference line."""
    out = audits.select(
        "model_id", "audit_id", "audit_timestamp", metric_value(metric).alias("metric_value")
    )
    return out if reference is None else out.withColumn("reference", F.lit(float(reference)))


def slice_drill_down(audits: DataFrame) -> DataFrame:
    return slice_rows(audits).select("audit_id", "attribute", "group_value", "pos_rate")


def fairness_dashboard(audits: DataFrame) -> DataFrame:
    """One row per model, day and metric: mean and worst value, breaches."""
    metrics = metric_rows(audits).join(
        audits.select("audit_id", F.to_date("audit_timestamp").alias("day")), "audit_id"
    )
    return metrics.groupBy("model_id", "day", "name").agg(
        F.avg("value").alias("mean_value"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
        F.count_if("breached").alias("breaches"),
        F.count(F.lit(1)).alias("audits"),
    )


def compliance_summary(audits: DataFrame) -> DataFrame:
    """One row per model and month: audits by severity and the worst one."""
    levels = {
        f"n_{s.lower()}": F.count_if(F.col("overall_severity") == s)
        for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "PASS")
    }
    return audits.groupBy("model_id", F.date_format("audit_timestamp", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("audits"),
        F.sum("sample_size").alias("predictions"),
        F.min_by("overall_severity", severity_rank("overall_severity")).alias("worst_severity"),
        *[c.alias(n) for n, c in levels.items()],
    )



def mitigation_timeline(log: DataFrame) -> DataFrame:
    """Before and after value of every metric of every mitigation."""
    return log.select(
        "mitigation_id",
        "model_id",
        "triggered_at",
        F.explode(F.array_union(F.map_keys("metrics_before"), F.map_keys("metrics_after"))).alias("name"),
        "metrics_before",
        "metrics_after",
    ).select(
        "mitigation_id",
        "model_id",
        "triggered_at",
        "name",
        F.col("metrics_before")[F.col("name")].alias("value_before"),
        F.col("metrics_after")[F.col("name")].alias("value_after"),
    )
