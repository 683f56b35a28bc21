"""Fairness metrics as named aggregate expressions over sided groups.

A metric is an SQL aggregate over the rows of ``with_sides``: one row per group
with its confusion counts (n, pred_pos, true_pos, tp, fp, tn, fn), the audit
totals and ``is_priv``. The same expression serves the point value and every
bootstrap replicate, so a metric added with ``register`` gets its interval,
breach flag and severity for free.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.schemas import BREACHED_BELOW, METRIC_THRESHOLDS, SIGNIFICANCE

TINY = 1e-10


@dataclass(frozen=True)
class GroupMetric:
    name: str
    expression: str
    threshold: float
    breached_below: bool = False
    # replicates with a side smaller than this count as zero
    side_minimum: int = 0


def ratio(num: str, den: str) -> str:
    """num/den, or 0 where there is nothing to divide by."""
    return f"coalesce(({num}) / nullif({den}, 0), 0D)"


def side(count: str, privileged: bool) -> str:
    """Sum of a count over the privileged group, or over all others together."""
    return f"sum(if({'' if privileged else 'NOT '}is_priv, {count}, 0))"


def side_ratio(num: str, den: str, privileged: bool) -> str:
    return ratio(side(num, privileged), side(den, privileged))


def spread(rate: str) -> str:
    return f"max({rate}) - min({rate})"


def side_gap(num: str, den: str) -> str:
    return f"abs({side_ratio(num, den, True)} - {side_ratio(num, den, False)})"


_SELECTION, _TPR, _FPR = ratio("pred_pos", "n"), ratio("tp", "true_pos"), ratio("fp", "fp + tn")


def _odds_gap(num: str, den: str) -> str:
    return f"{side_ratio(num, den, False)} - {side_ratio(num, den, True)}"


GROUP_METRICS = {
    "demographic_parity_difference": spread(_SELECTION),
    "equalized_odds_difference": f"greatest({spread(_TPR)}, {spread(_FPR)})",
    "equal_opportunity_difference": side_gap("tp", "true_pos"),
    # a missing privileged group counts as a vanishing rate
    "disparate_impact_ratio": f"{side_ratio('pred_pos', 'n', False)} / greatest("
    f"if({side('n', True)} > 0, {side_ratio('pred_pos', 'n', True)}, {TINY}D), {TINY}D)",
    "average_odds_difference": f"abs(({_odds_gap('fp', 'fp + tn')} + {_odds_gap('tp', 'true_pos')}) * 0.5D)",
    "statistical_parity_subgroup_lift": f"max({_SELECTION}) / greatest(min({_SELECTION}), {TINY}D)",
    "predictive_parity_difference": side_gap("tp", "pred_pos"),
    "counterfactual_fairness": side_gap("pred_pos", "n"),
}
SIDE_MINIMUMS = {
    "equal_opportunity_difference": 1,
    "average_odds_difference": 2,
    "predictive_parity_difference": 1,
    "counterfactual_fairness": 1,
}

_REGISTRY: dict = {}


def register(metric: GroupMetric) -> None:
    """Add a metric; from here on every audit computes it."""
    _REGISTRY[metric.name] = metric


def registered() -> list:
    return list(_REGISTRY.values())


for _name, _expression in GROUP_METRICS.items():
    register(
        GroupMetric(
            _name,
            _expression,
            METRIC_THRESHOLDS[_name],
            _name in BREACHED_BELOW,
            SIDE_MINIMUMS.get(_name, 0),
        )
    )


def metric_order() -> list:
    """Metric names in report order, user metrics last."""
    return [*METRIC_THRESHOLDS, *[n for n in _REGISTRY if n not in METRIC_THRESHOLDS]]


def thresholds() -> dict:
    """name -> (threshold, breached below it) for every known metric."""
    known = {n: (t, n in BREACHED_BELOW) for n, t in METRIC_THRESHOLDS.items()}
    known.update({m.name: (m.threshold, m.breached_below) for m in registered()})
    return known


def group_metric_columns(names=None, replicate: bool = False) -> list:
    """Aggregate columns of the registered metrics.

    ``replicate`` applies the small-side rule that holds for resamples only."""
    columns = []
    for m in registered():
        if names and m.name not in names:
            continue
        value = m.expression
        if replicate and m.side_minimum:
            smaller = f"least({side('n', True)}, {side('n', False)})"
            value = f"if({smaller} < {m.side_minimum}, 0D, {value})"
        columns.append(F.expr(value).alias(m.name))
    return columns


def group_metrics(sided: DataFrame, keys, names=None, replicate: bool = False) -> DataFrame:
    """Wide table, one column per metric, one row per key and attribute."""
    return sided.groupBy(*keys).agg(*group_metric_columns(names, replicate))


def calibration_gap(bins: DataFrame, keys) -> DataFrame:
    """Mean gap of observed positives over bins filled on both sides."""
    # an empty side makes its rate, and so the gap, null
    gap = "abs(true_priv / nullif(n_priv, 0) - true_unpriv / nullif(n_unpriv, 0))"
    return bins.groupBy(*keys).agg(F.expr(f"coalesce(avg({gap}), 0D)").alias("calibration_gap"))


def intersectional_bias(joint: DataFrame, keys, attributes, secondary) -> DataFrame:
    """Selection-rate spread over (attribute, second axis) groups.

    ``secondary`` maps each attribute to its second axis, a column of the
    joint cube; fewer than two groups give 0."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("attribute"),
                F.lit(i).alias("attribute_ord"),
                F.coalesce(F.col(a).cast("string"), F.lit("None")).alias("first"),
                F.coalesce(F.col(secondary[a]).cast("string"), F.lit("None")).alias("second"),
            )
            for i, a in enumerate(attributes)
        ]
    )
    # the cross group is one text, so two pairs spelling the same text are one group
    cross = F.concat("first", F.lit("_"), "second")
    rates = (
        joint.select(*keys, "y_pred", "n", F.inline(entries))
        .groupBy(*keys, "attribute", "attribute_ord", cross.alias("cross_group"))
        .agg((F.sum(F.when(F.col("y_pred") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))
    )
    return rates.groupBy(*keys, "attribute", "attribute_ord").agg(
        F.expr(spread("rate")).alias("intersectional_bias_score")
    )


# Strict comparison of the unrounded value with its threshold.
BREACH = "if(breached_below, value < threshold, value > threshold)"
# How many times over its threshold a metric is.
EXCESS = (
    f"if(breached_below, threshold / greatest(value, {TINY}D), value / greatest(threshold, {TINY}D))"
)
METRIC_SEVERITY = f"""CASE WHEN NOT breached THEN 'PASS' WHEN p_value > {SIGNIFICANCE}D THEN 'LOW'
  WHEN {EXCESS} > 3 THEN 'CRITICAL' WHEN {EXCESS} > 2 THEN 'HIGH' ELSE 'MEDIUM' END"""


def judge(long: DataFrame) -> DataFrame:
    """Add order, threshold, breach and severity to rows of name, value and p_value."""
    limits, order = thresholds(), metric_order()
    known = ", ".join(
        f"'{n}', named_struct('metric_ord', {i + 1}, 'threshold', {limits[n][0]!r}D,"
        f" 'breached_below', {str(limits[n][1]).lower()})"
        for i, n in enumerate(order)
    )
    return (
        long.withColumn("_known", F.expr(f"map({known})[name]"))
        .select("*", "_known.*")
        .drop("_known")
        .withColumn("breached", F.expr(BREACH))
        .withColumn("severity", F.expr(METRIC_SEVERITY))
    )


def long_metrics(wide: DataFrame, id_columns, names=None) -> DataFrame:
    """Unpivot wide metrics into one judged row each; ``wide`` must carry p_value."""
    names = [n for n in metric_order() if n in wide.columns and (not names or n in names)]
    return judge(wide.select(*id_columns, "p_value", named_values({n: n for n in names})))


def named_values(values: dict) -> Column:
    """One row of name and value per entry; values are SQL expressions."""
    rows = ", ".join(
        f"named_struct('name', '{n}', 'value', CAST({v} AS double))" for n, v in values.items()
    )
    return F.expr(f"inline(array({rows}))")
