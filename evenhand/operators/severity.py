"""Overall severity, required action and the last-attribute-wins view."""

from pyspark.sql import DataFrame, functions as F

from evenhand.operators.metrics import TINY
from evenhand.schemas import SEVERITIES, SEVERITY_ACTIONS, SEVERITY_GAUGE, SIGNIFICANCE


def last_attribute_wins(metrics: DataFrame, keys) -> DataFrame:
    """Merge the attributes' results by metric name; the last listed one stays."""
    kept = [c for c in metrics.columns if c not in (*keys, "name")]
    return (
        metrics.groupBy(*keys, "name")
        .agg(F.max_by(F.struct(*kept), F.col("attribute_ord")).alias("m"))
        .select(*keys, "name", "m.*")
    )


def overall_severity(metrics: DataFrame, keys) -> DataFrame:
    """One severity per audit from its judged metric rows.

    Reads values and p-values as reported, that is rounded to six places."""
    value, p = F.round("value", 6), F.round("p_value", 6)
    times = F.when(F.col("breached_below"), F.col("threshold") / F.greatest(value, F.lit(TINY)))
    times = F.when(
        F.col("breached") & (F.col("threshold") > 0), times.otherwise(value / F.col("threshold"))
    )
    facts = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_metrics"),
        F.count_if("breached").alias("n_breached"),
        F.max(F.when(F.col("name") == "disparate_impact_ratio", value)).alias("impact"),
        F.max(times).alias("worst"),
        F.max(F.when((times > 2) & (times <= 3), times)).alias("double_excess"),
        F.min(F.when(F.col("breached"), p)).alias("least_p"),
    )
    impact, breached = F.col("impact"), F.col("n_breached")
    severity = (
        F.when(breached == 0, "PASS")
        .when((impact < 0.65) | (F.col("worst") > 3) | (breached >= 3), "CRITICAL")
        .when(
            ((impact >= 0.65) & (impact < 0.80))
            | F.col("double_excess").isNotNull()
            | (breached == 2),
            "HIGH",
        )
        .when(F.col("least_p") < SIGNIFICANCE, "MEDIUM")
        .when(F.col("least_p") > SIGNIFICANCE, "LOW")
        .otherwise("MEDIUM")
    )
    return facts.select(
        *keys, "n_metrics", "n_breached", severity.alias("overall_severity")
    )


def severity_rank(column) -> F.Column:
    """0 for the worst severity, growing towards PASS."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(column)).cast("int") - 1


def severity_gauge(column) -> F.Column:
    """Gauge number of a severity; unknown names count as 0."""
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_GAUGE.items() for x in kv])
    return F.coalesce(table[F.col(column)], F.lit(0))


def required_action(audits: DataFrame, column: str = "overall_severity") -> DataFrame:
    """Attach action, delay and the notify and log flags. Unknown acts as PASS."""
    fields = ("action", "delay_seconds", "notify", "log_to_warehouse", "log_to_ledger")

    def pick(i):
        out = None
        for s, row in SEVERITY_ACTIONS.items():
            test = F.col(column) == s
            out = F.when(test, F.lit(row[i])) if out is None else out.when(test, F.lit(row[i]))
        return out.otherwise(F.lit(SEVERITY_ACTIONS["PASS"][i]))

    return audits.withColumns({f: pick(i) for i, f in enumerate(fields)})


def top_violation(metrics: DataFrame, keys) -> DataFrame:
    """First breached metric in report order; ``none`` and zeros where all pass."""
    first = F.min_by(
        F.struct("name", "value", "threshold"), F.when(F.col("breached"), F.col("metric_ord"))
    )
    return metrics.groupBy(*keys).agg(first.alias("top")).select(
        *keys,
        F.coalesce("top.name", F.lit("none")).alias("top_metric_name"),
        F.coalesce("top.value", F.lit(0.0)).alias("top_metric_value"),
        F.coalesce("top.threshold", F.lit(0.0)).alias("top_metric_threshold"),
    )
