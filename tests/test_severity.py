import math

import pytest
from pyspark.sql import functions as F

from evenhand.operators import severity as V
from evenhand.operators.metrics import judge
from evenhand.operators.significance import chi2_tail, chi_square
from evenhand.schemas import METRIC_THRESHOLDS

DPD, EOD, DI, LIFT = (
    "demographic_parity_difference",
    "equalized_odds_difference",
    "disparate_impact_ratio",
    "statistical_parity_subgroup_lift",
)


def judged(spark, metrics):
    rows = [("m", n, float(v), float(p)) for n, v, p in metrics]
    return judge(spark.createDataFrame(rows, "model_id string, name string, value double, p_value double"))


@pytest.mark.parametrize(
    "metrics, expected",
    [
        ([(DPD, 0.05, 0.01), (DI, 0.95, 0.01)], "PASS"),
        ([(DI, 0.60, 0.01)], "CRITICAL"),  # far below the four-fifths rule
        ([(DPD, 0.35, 0.01)], "CRITICAL"),  # more than three times over
        ([(DPD, 0.11, 0.01), (EOD, 0.09, 0.01), (LIFT, 1.3, 0.01)], "CRITICAL"),  # three at once
        ([(DI, 0.70, 0.01)], "HIGH"),
        ([(DPD, 0.25, 0.01)], "HIGH"),  # two to three times over
        ([(DPD, 0.11, 0.01), (EOD, 0.09, 0.01)], "HIGH"),  # two at once
        ([(DPD, 0.30, 0.01)], "HIGH"),  # three times is not more than three times
        ([(DPD, 0.12, 0.01)], "MEDIUM"),
        ([(DPD, 0.12, 0.20)], "LOW"),
        ([(DPD, 0.12, 0.05)], "MEDIUM"),  # neither below nor above the level
        ([(DPD, 0.35, 0.90)], "CRITICAL"),  # significance does not soften the worst classes
        ([(DI, 0.65, 0.01)], "HIGH"),
        ([(DI, 0.80, 0.01)], "PASS"),  # strict comparison
    ],
)
def test_overall_severity(spark, metrics, expected):
    assert V.overall_severity(judged(spark, metrics), ["model_id"]).first()["overall_severity"] == expected


@pytest.mark.parametrize(
    "name, value, p, expected",
    [
        (DPD, 0.10, 0.0, "PASS"),
        (DPD, 0.11, 0.06, "LOW"),
        (DPD, 0.11, 0.05, "MEDIUM"),
        (DPD, 0.21, 0.0, "HIGH"),
        (DPD, 0.31, 0.0, "CRITICAL"),
        (DI, 0.5, 0.0, "MEDIUM"),
        (DI, 0.39, 0.0, "HIGH"),
        (DI, 0.0, 0.0, "CRITICAL"),
        ("individual_fairness_score", 0.84, 0.0, "MEDIUM"),
    ],
)
def test_metric_severity(spark, name, value, p, expected):
    assert judged(spark, [(name, value, p)]).first()["severity"] == expected


def test_actions(spark):
    df = spark.createDataFrame([(s,) for s in (*V.SEVERITIES, "?")], "overall_severity string")
    got = {r["overall_severity"]: r for r in V.required_action(df).collect()}
    assert got["CRITICAL"]["delay_seconds"] == 0 and got["HIGH"]["delay_seconds"] == 3600
    assert got["MEDIUM"]["delay_seconds"] is None and not got["MEDIUM"]["notify"]
    assert not got["LOW"]["log_to_warehouse"] and got["LOW"]["log_to_ledger"]
    assert got["?"]["action"] == "LOG_CLEAN"


def test_top_violation_and_last_attribute(spark):
    rows = judged(spark, [(EOD, 0.2, 0.0), (DPD, 0.05, 0.0), (DI, 0.5, 0.0)])
    top = V.top_violation(rows, ["model_id"]).first()
    assert (top["top_metric_name"], top["top_metric_value"]) == (EOD, 0.2)
    none = V.top_violation(judged(spark, [(DPD, 0.05, 0.0)]), ["model_id"]).first()
    assert tuple(none)[1:] == ("none", 0.0, 0.0)
    both = rows.withColumn("attribute_ord", F.lit(0)).unionByName(
        judged(spark, [(EOD, 0.3, 0.0)]).withColumn("attribute_ord", F.lit(1))
    )
    merged = {r["name"]: r["value"] for r in V.last_attribute_wins(both, ["model_id"]).collect()}
    assert merged == {EOD: 0.3, DPD: 0.05, DI: 0.5}


def test_all_metrics_have_a_direction(spark):
    rows = judged(spark, [(n, t, 0.0) for n, t in METRIC_THRESHOLDS.items()])
    assert rows.where("breached").count() == 0 and rows.count() == 12


def numeric_tail(x, k, steps=200000, top=400.0):
    """Area under the density from x on, by the midpoint rule."""
    width = (top - x) / steps
    const = -(k / 2) * math.log(2) - math.lgamma(k / 2)
    return width * sum(
        math.exp(const + (k / 2 - 1) * math.log(v) - v / 2) for v in (x + (i + 0.5) * width for i in range(steps))
    )


@pytest.mark.parametrize("x, k", [(3.84, 1), (0.5, 2), (2.84, 4), (7.0, 3), (15.0, 9), (120.0, 100)])
def test_tail(spark, x, k):
    got = spark.range(1).select(chi2_tail(F.lit(x), F.lit(float(k)))).first()[0]
    assert got == pytest.approx(numeric_tail(x, k), rel=2e-3, abs=1e-9)


def test_statistic_is_corrected_for_two_groups(spark):
    from evenhand.operators import cube

    rows = [("m", "Male", 500, 350), ("m", "Female", 500, 125)]
    groups = spark.createDataFrame(rows, "model_id string, group_value string, n long, pred_pos long")
    groups = groups.withColumn("attribute", F.lit("sex")).withColumn("attribute_ord", F.lit(0))
    both = cube.with_sides(groups, cube.audit_frame(groups, ["model_id"]), ["model_id"])
    got = chi_square(both, ["model_id"]).first()
    assert got["chi2"] == pytest.approx(201.21, abs=0.01) and got["dof"] == 1
    assert got["p_value"] < 1e-40


def test_no_test_with_one_group_or_one_answer(spark):
    from evenhand.operators import cube

    for rows in ([("m", "A", 10, 4)], [("m", "A", 10, 10), ("m", "B", 10, 10)]):
        groups = spark.createDataFrame(rows, "model_id string, group_value string, n long, pred_pos long")
        groups = groups.withColumn("attribute", F.lit("x")).withColumn("attribute_ord", F.lit(0))
        both = cube.with_sides(groups, cube.audit_frame(groups, ["model_id"]), ["model_id"])
        assert chi_square(both, ["model_id"]).first()["p_value"] == 1.0
