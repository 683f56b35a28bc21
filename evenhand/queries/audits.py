"""Audit queries: cube, metrics, significance, severity and the full audit."""

import uuid

from pyspark.sql import functions as F

from evenhand.operators import bootstrap, cube, metrics as M, severity as V
from evenhand.operators.individual import individual_fairness, sampled_individual_fairness
from evenhand.operators.significance import chi_square as chi_square_test
from evenhand.operators.slices import SLICE_MEASURES, demographic_slices, nested_slices
from evenhand.operators.temporal import temporal_drift as drift_over_windows, window_gaps
from evenhand.plans import audit as A
from evenhand.queries import query
from evenhand.queries.views import ATTRIBUTES, FRAME, GROUPS, KEYS, LONG, P, predictions
from evenhand.schemas import METRIC_THRESHOLDS
from evenhand.session import scratch_dir

IDS = [*KEYS, "attribute", "attribute_ord"]
COUNTS = ("n", "pred_pos", "true_pos", "tp", "fp", "tn", "fn")


def _joint(spark, folder):
    return cube.joint_cube(predictions(spark, folder), KEYS, ATTRIBUTES)


def _sided(spark, folder):
    joint = cube.joint_cube(predictions(spark, folder), KEYS, ATTRIBUTES, bins=False)
    groups = cube.group_cube(joint, KEYS, ATTRIBUTES)
    return cube.with_sides(groups, cube.audit_frame(groups, KEYS), KEYS)


@query(f"WITH {GROUPS} SELECT * EXCLUDE (attribute_ord) FROM g")
def confusion_cube(spark, folder):
    return cube.confusion_cube(predictions(spark, folder), KEYS, ATTRIBUTES).drop("attribute_ord")


_SLICE_SQL = """
  n AS count,
  round(pred_pos / greatest(n, 1), 6) AS positive_rate,
  round(true_pos / greatest(n, 1), 6) AS base_rate,
  round(tp / greatest(tp + fn, 1), 6) AS true_positive_rate,
  round(fp / greatest(fp + tn, 1), 6) AS false_positive_rate,
  round(tn / greatest(tn + fp, 1), 6) AS true_negative_rate,
  round(fn / greatest(fn + tp, 1), 6) AS false_negative_rate,
  round(tp / greatest(tp + fp, 1), 6) AS precision,
  round((tp + tn) / greatest(n, 1), 6) AS accuracy"""


def _rounded_slices(groups, extra=()):
    sliced = demographic_slices(groups, [*KEYS, *extra])
    return sliced.select(
        *KEYS,
        *extra,
        "attribute",
        "group_value",
        "count",
        *[F.round(m, 6).alias(m) for m in SLICE_MEASURES if m != "count"],
    )


@query(f"WITH {GROUPS} SELECT model_id, attribute, group_value, {_SLICE_SQL} FROM g")
def slices(spark, folder):
    return _rounded_slices(cube.confusion_cube(predictions(spark, folder), KEYS, ATTRIBUTES))


@query(
    f"""WITH {P}, g AS (
  SELECT model_id, 'sex×segment' AS attribute, sex || '_' || segment AS group_value,
         CAST(count(*) AS BIGINT) AS n, CAST(sum(y_pred) AS BIGINT) AS pred_pos,
         CAST(sum(y_true) AS BIGINT) AS true_pos,
         CAST(sum(y_pred * y_true) AS BIGINT) AS tp,
         CAST(sum(y_pred * (1 - y_true)) AS BIGINT) AS fp,
         CAST(sum((1 - y_pred) * (1 - y_true)) AS BIGINT) AS tn,
         CAST(sum((1 - y_pred) * y_true) AS BIGINT) AS fn
  FROM p GROUP BY ALL)
SELECT model_id, attribute, group_value, {_SLICE_SQL} FROM g"""
)
def intersectional_slices(spark, folder):
    joint = cube.joint_cube(predictions(spark, folder), KEYS, ATTRIBUTES, bins=False)
    return _rounded_slices(cube.intersectional_cube(joint, KEYS, [ATTRIBUTES]))


@query(
    f"""WITH {GROUPS}
SELECT model_id, attribute, group_value, unnest(['count', 'positive_rate', 'base_rate']) AS measure,
       round(unnest([CAST(n AS DOUBLE), pred_pos / n, true_pos / n]), 6) AS measure_value
FROM g"""
)
def slice_measures(spark, folder):
    groups = cube.confusion_cube(predictions(spark, folder), KEYS, ATTRIBUTES)
    nested = nested_slices(demographic_slices(groups, KEYS), KEYS)
    return nested.select(
        *KEYS,
        "slice.attribute",
        "slice.group_value",
        F.explode("slice.metrics").alias("measure", "measure_value"),
    ).where(F.col("measure").isin("count", "positive_rate", "base_rate"))


@query(
    f"""WITH {GROUPS}
SELECT model_id, attribute, group_value, y_pred, CAST(cell_n AS BIGINT) AS cell_n FROM (
  SELECT model_id, attribute, group_value, 0 AS y_pred, n - pred_pos AS cell_n FROM g
  UNION ALL SELECT model_id, attribute, group_value, 1, pred_pos FROM g)"""
)
def contingency_table(spark, folder):
    groups = cube.confusion_cube(predictions(spark, folder), KEYS, ATTRIBUTES)
    return cube.contingency(groups, KEYS)


@query(
    f"""WITH {FRAME}
SELECT model_id, attribute, privileged_group, sample_size, CAST(group_count AS BIGINT) AS group_count FROM f"""
)
def privileged_group(spark, folder):
    groups = cube.confusion_cube(predictions(spark, folder), KEYS, ATTRIBUTES)
    return cube.audit_frame(groups, KEYS).select(
        *KEYS, "attribute", "privileged_group", "sample_size", "group_count"
    )


@query(
    f"""WITH {P}
SELECT model_id, CAST(month AS VARCHAR) AS month, count(*) AS sample_size,
       CASE WHEN count(*) >= 100 THEN 'OK' ELSE 'INSUFFICIENT_SAMPLE' END AS status
FROM (SELECT model_id, strftime(ts, '%Y-%m') AS month FROM p) GROUP BY ALL"""
)
def sample_gate(spark, folder):
    rows = predictions(spark, folder).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return cube.sample_gate(rows, ["model_id", "month"], 100)


@query(
    f"""WITH {P}, r AS (SELECT model_id, strftime(ts, '%Y-%m') AS month, line_no <> 7 AND quantity <> 50 AS readable FROM p)
SELECT model_id, month, count(*) AS "rows", count(*) FILTER (readable) AS sample_size, count(*) FILTER (NOT readable) AS unreadable,
  CASE WHEN count(*) FILTER (readable) < 100 THEN 'INSUFFICIENT_SAMPLE' WHEN count(*) FILTER (NOT readable) > 0 THEN 'UNREADABLE_LABELS'
    ELSE 'OK' END AS status FROM r GROUP BY 1, 2"""
)
def audit_status(spark, folder):
    """Why a model's month is not audited, or not in full: labels that read as no number."""
    rows = predictions(spark, folder).select(
        "model_id",
        F.date_format("ts", "yyyy-MM").alias("month"),
        F.when(F.col("line_no") == 7, "n/a").otherwise(F.col("y_true").cast("string")).alias("ground_truth"),
        F.when(F.col("quantity") != 50, F.col("y_pred").cast("string")).alias("prediction_label"),
        F.col("y_score").alias("prediction_score"),
    )
    return A.label_status(A.label_columns(rows), ["model_id", "month"])


_PRIV = "sum(CASE WHEN pr = 1 THEN {c} ELSE 0 END)"
_UNPRIV = "sum(CASE WHEN pr = 0 THEN {c} ELSE 0 END)"


def _q(num, den):
    return f"coalesce(({num}) / nullif(({den}), 0), 0)"


def _pu(num, den):
    p = _q(_PRIV.format(c=num), _PRIV.format(c=den))
    u = _q(_UNPRIV.format(c=num), _UNPRIV.format(c=den))
    return p, u


_tpr_p, _tpr_u = _pu("tp", "true_pos")
_fpr_p, _fpr_u = _pu("fp", "fp + tn")
_sel_p, _sel_u = _pu("pred_pos", "n")
_ppv_p, _ppv_u = _pu("tp", "pred_pos")

METRIC_SQL = {
    "demographic_parity_difference": "max(pred_pos / n) - min(pred_pos / n)",
    "equalized_odds_difference": f"greatest(max({_q('tp', 'true_pos')}) - min({_q('tp', 'true_pos')}),"
    f" max({_q('fp', 'fp + tn')}) - min({_q('fp', 'fp + tn')}))",
    "equal_opportunity_difference": f"abs({_tpr_p} - {_tpr_u})",
    "disparate_impact_ratio": f"{_sel_u} / greatest(CASE WHEN {_PRIV.format(c='n')} > 0"
    f" THEN {_sel_p} ELSE 1e-10 END, 1e-10)",
    "average_odds_difference": f"abs(0.5 * (({_fpr_u} - {_fpr_p}) + ({_tpr_u} - {_tpr_p})))",
    "statistical_parity_subgroup_lift": "max(pred_pos / n) / greatest(min(pred_pos / n), 1e-10)",
    "predictive_parity_difference": f"abs({_ppv_p} - {_ppv_u})",
    "counterfactual_fairness": f"abs({_sel_p} - {_sel_u})",
}

# Score bins written as SQL: half-open ranges between the fixed edges.
BIN_SQL = "CASE " + " ".join(
    f"WHEN y_score >= {lo!r} AND y_score < {hi!r} THEN {i}"
    for i, (lo, hi) in enumerate(zip(cube.SCORE_EDGES, cube.SCORE_EDGES[1:]))
) + " END"

CALIBRATION_CTE = f"""
bins AS (
  SELECT l.model_id, l.attribute, {BIN_SQL} AS bin,
         avg(CASE WHEN l.group_value = f.privileged_group THEN y_true END) AS tp_,
         avg(CASE WHEN l.group_value <> f.privileged_group THEN y_true END) AS tu_
  FROM long l JOIN f USING (model_id, attribute)
  WHERE y_score >= 0 AND y_score < 1 GROUP BY 1, 2, 3),
m8 AS (SELECT model_id, attribute, coalesce(avg(abs(tp_ - tu_)), 0) AS calibration_gap
       FROM bins GROUP BY ALL)"""

INTERSECTION_CTE = """
m11 AS (SELECT model_id, attribute, max(r) - min(r) AS intersectional_bias_score FROM (
  SELECT model_id, attribute, group_value || '_' || other AS x, avg(y_pred) AS r
  FROM long GROUP BY ALL) GROUP BY ALL)"""

# exact pair score: sorted prefix sums over rows, all pairs minus same-group pairs
PAIRS_CTE = """
ranked AS (
  SELECT *,
    row_number() OVER a - 1 AS ka, coalesce(sum(y_score) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS xa,
    row_number() OVER b - 1 AS kb, coalesce(sum(y_score) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS xb
  FROM long
  WINDOW a AS (PARTITION BY model_id, attribute, y_true ORDER BY y_score, event_id),
         b AS (PARTITION BY model_id, attribute, y_true, group_value ORDER BY y_score, event_id)),
m9 AS (SELECT model_id, attribute, CAST(sum(ka - kb) AS DOUBLE) AS pairs,
         coalesce(least(greatest(1 - sum(y_score * (ka - kb) - (xa - xb)) / nullif(sum(ka - kb), 0), 0), 1), 1)
         AS individual_fairness_score
       FROM ranked GROUP BY ALL)"""

# time windows over row numbers; the running CUSUM in closed form
WINDOWS_CTE = """
ro AS (SELECT model_id, event_id, row_number() OVER (PARTITION BY model_id ORDER BY ts, event_id) - 1 AS r,
              count(*) OVER (PARTITION BY model_id) AS nn FROM p),
sz AS (SELECT *, greatest(nn // 10, 50) AS size, greatest(nn // 10, 50) // 2 AS step FROM ro),
win AS (SELECT model_id, event_id, unnest(range(greatest(0, CAST(ceil((r - size + 1) / step) AS BIGINT)),
                                    least(r // step, (nn - size) // step) + 1)) AS k FROM sz),
gaps AS (SELECT l.model_id, l.attribute, k,
           abs(avg(CASE WHEN l.group_value = f.privileged_group THEN y_pred END)
             - avg(CASE WHEN l.group_value <> f.privileged_group THEN y_pred END)) AS gap
         FROM win JOIN long l USING (model_id, event_id) JOIN f USING (model_id, attribute)
         GROUP BY ALL HAVING gap IS NOT NULL),
steps AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
            ELSE gap - min(gap) OVER (PARTITION BY model_id, attribute) - 0.05 END AS inc
          FROM gaps WINDOW w AS (PARTITION BY model_id, attribute ORDER BY k)),
runs AS (SELECT *, sum(inc) OVER (PARTITION BY model_id, attribute ORDER BY k) AS c FROM steps),
m12 AS (SELECT model_id, attribute, count(*) AS windows,
          CASE WHEN count(*) > 2 THEN greatest(max(c - lo), 0) ELSE 0 END AS temporal_drift_index
        FROM (SELECT *, min(c) OVER (PARTITION BY model_id, attribute ORDER BY k) AS lo FROM runs) GROUP BY 1, 2)"""


def _metric_query(name):
    oracle = (
        f"WITH {FRAME} SELECT model_id, attribute, round({METRIC_SQL[name]}, 6) AS value "
        "FROM s GROUP BY model_id, attribute"
    )

    def run(spark, folder):
        wide = M.group_metrics(_sided(spark, folder), IDS, [name])
        return wide.select("model_id", "attribute", F.round(name, 6).alias("value"))

    run.__name__ = name
    return query(oracle)(run)


for _name in METRIC_SQL:
    _metric_query(_name)


@query(
    f"WITH {FRAME}, {CALIBRATION_CTE} SELECT model_id, attribute, round(calibration_gap, 6) AS value FROM m8"
)
def calibration_gap(spark, folder):
    joint = _joint(spark, folder)
    frame = cube.audit_frame(cube.group_cube(joint, KEYS, ATTRIBUTES), KEYS)
    bins = cube.score_bin_cube(joint, frame, KEYS, ATTRIBUTES)
    return M.calibration_gap(bins, IDS).select(
        "model_id", "attribute", F.round("calibration_gap", 6).alias("value")
    )


@query(
    f"""WITH {FRAME}
SELECT model_id, attribute, score_bin, n_priv, n_unpriv, true_priv, true_unpriv FROM (
  SELECT l.model_id, l.attribute, {BIN_SQL} AS score_bin,
    count(*) FILTER (l.group_value = f.privileged_group) AS n_priv,
    count(*) FILTER (l.group_value <> f.privileged_group) AS n_unpriv,
    CAST(coalesce(sum(y_true) FILTER (l.group_value = f.privileged_group), 0) AS BIGINT) AS true_priv,
    CAST(coalesce(sum(y_true) FILTER (l.group_value <> f.privileged_group), 0) AS BIGINT) AS true_unpriv
  FROM long l JOIN f USING (model_id, attribute) GROUP BY 1, 2, 3) WHERE score_bin IS NOT NULL"""
)
def score_bins(spark, folder):
    joint = _joint(spark, folder)
    frame = cube.audit_frame(cube.group_cube(joint, KEYS, ATTRIBUTES), KEYS)
    return cube.score_bin_cube(joint, frame, KEYS, ATTRIBUTES).drop("attribute_ord")


@query(
    f"WITH {LONG}, {INTERSECTION_CTE} SELECT model_id, attribute, round(intersectional_bias_score, 6) AS value FROM m11"
)
def intersectional_bias_score(spark, folder):
    joint = cube.joint_cube(predictions(spark, folder), KEYS, ATTRIBUTES, bins=False)
    axes = A.second_axes(ATTRIBUTES, compat=False)
    return M.intersectional_bias(joint, KEYS, ATTRIBUTES, axes).select(
        "model_id", "attribute", F.round("intersectional_bias_score", 6).alias("value")
    )


@query(
    f"""WITH {LONG} SELECT model_id, attribute, round(max(r) - min(r), 6) AS value FROM (
  SELECT model_id, attribute, group_value, y_true, avg(y_pred) AS r FROM long GROUP BY ALL) GROUP BY ALL"""
)
def intersectional_bias_by_truth(spark, folder):
    joint = cube.joint_cube(predictions(spark, folder), KEYS, ATTRIBUTES, bins=False)
    axes = A.second_axes(ATTRIBUTES, compat=True)
    return M.intersectional_bias(joint, KEYS, ATTRIBUTES, axes).select(
        "model_id", "attribute", F.round("intersectional_bias_score", 6).alias("value")
    )


@query(
    f"WITH {LONG}, {PAIRS_CTE} SELECT model_id, attribute, pairs, round(individual_fairness_score, 6) AS value FROM m9"
)
def individual_fairness_score(spark, folder):
    return individual_fairness(predictions(spark, folder), KEYS, ATTRIBUTES).select(
        "model_id", "attribute", "pairs", F.round("individual_fairness_score", 6).alias("value")
    )


@query()
def individual_fairness_sampled(spark, folder):
    return sampled_individual_fairness(predictions(spark, folder), KEYS, "sex", "event_id")


@query(
    f"WITH {FRAME}, {WINDOWS_CTE} SELECT model_id, attribute, windows, round(temporal_drift_index, 6) AS value FROM m12"
)
def temporal_drift_index(spark, folder):
    rows = predictions(spark, folder)
    frame = cube.audit_frame(cube.confusion_cube(rows, KEYS, ATTRIBUTES), KEYS)
    gaps = window_gaps(rows, frame, KEYS, ATTRIBUTES, ["ts", "event_id"])
    return drift_over_windows(gaps, KEYS).select(
        "model_id", "attribute", "windows", F.round("temporal_drift_index", 6).alias("value")
    )


# statistic with Yates' correction on one degree of freedom
CHI_CTE = """
x AS (SELECT model_id, attribute, group_count, n, n * sample_pos / sample_size AS e1,
             n - n * sample_pos / sample_size AS e0, pred_pos AS o1 FROM s),
d AS (SELECT *, CASE WHEN group_count = 2 THEN greatest(abs(o1 - e1) - 0.5, 0) ELSE abs(o1 - e1) END AS dev FROM x),
chi AS (SELECT model_id, attribute, sum(dev * dev / e1 + dev * dev / e0) AS chi2,
               CAST(max(group_count) - 1 AS BIGINT) AS dof FROM d GROUP BY ALL)"""


_ALL_METRICS = {
    **{n: f"m.{n}" for n in METRIC_SQL},
    "calibration_gap": "m8.calibration_gap",
    "individual_fairness_score": "m9.individual_fairness_score",
    "intersectional_bias_score": "m11.intersectional_bias_score",
    "temporal_drift_index": "coalesce(m12.temporal_drift_index, 0)",
}
_BELOW = ("disparate_impact_ratio", "individual_fairness_score")
_STRUCTS = ", ".join(
    f"{{'metric_ord': {i + 1}, 'name': '{n}', 'value': CAST({_ALL_METRICS[n]} AS DOUBLE), "
    f"'threshold': CAST({t!r} AS DOUBLE), 'below': {str(n in _BELOW).lower()}}}"
    for i, (n, t) in enumerate(METRIC_THRESHOLDS.items())
)
# tail of chi-square: in closed form for four degrees of freedom, and for one by the series
# of the error function whose terms are all positive
ONE_DOF = """CASE WHEN chi2 <= 0 THEN 1.0 WHEN chi2 > 60 THEN 0.0 ELSE 1 - sqrt(2 * chi2 / pi()) * exp(-chi2 / 2) *
  list_sum(list_transform(range(0, 200), lambda k: exp(k * ln(chi2) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))) END"""
P_VALUE = f"CASE WHEN dof = 4 THEN exp(-chi2 / 2) * (1 + chi2 / 2) ELSE {ONE_DOF} END"
JUDGED_CTE = f"""{FRAME}, {CHI_CTE}, {CALIBRATION_CTE}, {INTERSECTION_CTE}, {PAIRS_CTE}, {WINDOWS_CTE},
m AS (SELECT model_id, attribute, attribute_ord, {", ".join(f"{e} AS {n}" for n, e in METRIC_SQL.items())}
      FROM s GROUP BY ALL),
un AS (SELECT model_id, attribute, attribute_ord,
         {P_VALUE} AS p_value,
         unnest([{_STRUCTS}]) AS e
       FROM m JOIN chi USING (model_id, attribute) JOIN m8 USING (model_id, attribute)
       JOIN m9 USING (model_id, attribute) JOIN m11 USING (model_id, attribute)
       LEFT JOIN m12 USING (model_id, attribute)),
jb AS (SELECT model_id, attribute, attribute_ord, p_value, e.metric_ord AS metric_ord, e.name AS name,
         e.value AS value, e.threshold AS threshold, e.below AS below,
         CASE WHEN e.below THEN e.value < e.threshold ELSE e.value > e.threshold END AS breached,
         CASE WHEN e.below THEN e.threshold / greatest(e.value, 1e-10) ELSE e.value / e.threshold END AS times
       FROM un),
judged AS (SELECT *, CASE WHEN NOT breached THEN 'PASS' WHEN p_value > 0.05 THEN 'LOW'
             WHEN times > 3 THEN 'CRITICAL' WHEN times > 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM jb)"""

# overall severity over the rows of one relation of judged metrics
OVERALL_SQL = """
SELECT {keys}, count(*) AS n_metrics, count(*) FILTER (breached) AS n_breached,
  CASE WHEN count(*) FILTER (breached) = 0 THEN 'PASS'
       WHEN min(round(value, 6)) FILTER (name = 'disparate_impact_ratio') < 0.65
         OR max(times6) FILTER (breached) > 3 OR count(*) FILTER (breached) >= 3 THEN 'CRITICAL'
       WHEN min(round(value, 6)) FILTER (name = 'disparate_impact_ratio') < 0.80
         OR max(times6) FILTER (breached) > 2 OR count(*) FILTER (breached) = 2 THEN 'HIGH'
       WHEN min(round(p_value, 6)) FILTER (breached) < 0.05 THEN 'MEDIUM'
       WHEN min(round(p_value, 6)) FILTER (breached) > 0.05 THEN 'LOW'
       ELSE 'MEDIUM' END AS overall_severity
FROM (SELECT *, CASE WHEN below THEN threshold / greatest(round(value, 6), 1e-10)
                     ELSE round(value, 6) / threshold END AS times6 FROM {rel}) GROUP BY {keys}"""


@query(
    f"""WITH {FRAME}, {CHI_CTE}
SELECT model_id, attribute, dof, round(chi2, 6) AS chi2, round({P_VALUE}, 6) AS p_value, {P_VALUE} < 0.05 AS significant FROM chi"""
)
def chi_square(spark, folder):
    return chi_square_test(_sided(spark, folder), KEYS).select(
        "model_id",
        "attribute",
        "dof",
        F.round("chi2", 6).alias("chi2"),
        F.round("p_value", 6).alias("p_value"),
        (F.col("p_value") < 0.05).alias("significant"),
    )


def _judged(spark, folder, **options):
    return A.audit_metrics(
        predictions(spark, folder), KEYS, ATTRIBUTES, intervals=False, **options
    )


@query(
    f"""WITH {JUDGED_CTE}
SELECT model_id, attribute, metric_ord, name, round(value, 6) AS value, threshold, breached, severity,
       CAST(f.privileged_group AS VARCHAR) AS privileged_group, compared_group,
       privileged_size, unprivileged_size
FROM judged JOIN f USING (model_id, attribute, attribute_ord)
JOIN (SELECT model_id, attribute, min(group_value) FILTER (pr = 0) AS compared_group,
             CAST(sum(n) FILTER (pr = 1) AS BIGINT) AS privileged_size,
             CAST(sum(n) FILTER (pr = 0) AS BIGINT) AS unprivileged_size
      FROM s GROUP BY ALL) USING (model_id, attribute)"""
)
def full_audit_long(spark, folder):
    return _judged(spark, folder).select(
        "model_id",
        "attribute",
        "metric_ord",
        "name",
        F.round("value", 6).alias("value"),
        "threshold",
        "breached",
        "severity",
        "privileged_group",
        "compared_group",
        "privileged_size",
        "unprivileged_size",
    )


_MERGED = "(SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY model_id, name ORDER BY attribute_ord DESC) = 1)"


@query(f"WITH {JUDGED_CTE} {OVERALL_SQL.format(keys='model_id, attribute', rel='judged')}")
def severity_by_attribute(spark, folder):
    return V.overall_severity(_judged(spark, folder), ["model_id", "attribute"])


@query(
    f"""WITH {JUDGED_CTE}, o AS ({OVERALL_SQL.format(keys='model_id', rel=_MERGED)})
SELECT model_id, n_metrics, n_breached, overall_severity,
  CASE overall_severity WHEN 'CRITICAL' THEN 'TRIGGER_PIPELINE' WHEN 'HIGH' THEN 'QUEUE_PIPELINE'
    WHEN 'MEDIUM' THEN 'LOG_AND_HIGHLIGHT' WHEN 'LOW' THEN 'LOG_ONLY' ELSE 'LOG_CLEAN' END AS action,
  CASE overall_severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 3600 END AS delay_seconds,
  overall_severity IN ('CRITICAL', 'HIGH') AS notify,
  overall_severity <> 'LOW' AS log_to_warehouse, true AS log_to_ledger
FROM o"""
)
def severity_and_action(spark, folder):
    merged = V.last_attribute_wins(_judged(spark, folder), KEYS)
    return V.required_action(V.overall_severity(merged, KEYS))


@query(
    f"""WITH {JUDGED_CTE}
SELECT model_id, coalesce(arg_min(name, metric_ord) FILTER (breached), 'none') AS top_metric_name,
       round(coalesce(arg_min(value, metric_ord) FILTER (breached), 0), 6) AS top_metric_value,
       coalesce(arg_min(threshold, metric_ord) FILTER (breached), 0) AS top_metric_threshold
FROM {_MERGED} GROUP BY model_id"""
)
def top_violation(spark, folder):
    merged = V.last_attribute_wins(_judged(spark, folder), KEYS)
    return V.top_violation(merged, KEYS).withColumn(
        "top_metric_value", F.round("top_metric_value", 6)
    )


@query(
    f"""WITH {FRAME}
SELECT model_id, attribute, round(max(pred_pos / n) - min(pred_pos / n), 6) AS parity_gap,
  round({METRIC_SQL['disparate_impact_ratio']}, 6) AS impact_ratio,
  {METRIC_SQL['disparate_impact_ratio']} < 0.8 AS impact_breached,
  CAST(sum(n) AS BIGINT) AS sample_size
FROM s GROUP BY model_id, attribute"""
)
def audit_summary(spark, folder):
    names = ["demographic_parity_difference", "disparate_impact_ratio"]
    sided = _sided(spark, folder)
    wide = sided.groupBy(*IDS).agg(F.sum("n").alias("sample_size"), *M.group_metric_columns(names))
    return wide.select(
        "model_id",
        "attribute",
        F.round("demographic_parity_difference", 6).alias("parity_gap"),
        F.round("disparate_impact_ratio", 6).alias("impact_ratio"),
        (F.col("disparate_impact_ratio") < 0.8).alias("impact_breached"),
        "sample_size",
    )


@query(
    f"""WITH {JUDGED_CTE} SELECT model_id, attribute, name, true AS ordered,
  CASE WHEN attribute = 'sex' AND name = 'demographic_parity_difference' THEN true END AS width_as_expected
FROM judged WHERE name NOT IN ('calibration_gap', 'individual_fairness_score', 'intersectional_bias_score', 'temporal_drift_index')"""
)
def bootstrap_intervals(spark, folder):
    """Intervals are ordered, and the parity gap of two groups is as wide as theory has it.

    Its width over that of a normal interval lies near 1; near 0 for a gap about zero,
    whose sign is dropped."""
    sided = _sided(spark, folder)
    rate = F.col("pred_pos") / F.col("n")
    error = F.sqrt(F.sum(rate * (1 - rate) / F.col("n"))).alias("error")
    drawn = bootstrap.group_intervals(sided, IDS).join(sided.groupBy(*IDS).agg(error), IDS)
    width = (F.col("ci_upper") - F.col("ci_lower")) / (2 * 1.96 * F.col("error"))
    plain = (F.col("attribute") == "sex") & (F.col("name") == "demographic_parity_difference")
    return drawn.select(
        "model_id",
        "attribute",
        "name",
        (F.col("ci_lower") <= F.col("ci_upper")).alias("ordered"),
        F.when(plain, width.between(0.4, 1.2)).alias("width_as_expected"),
    )


@query(
    f"""WITH {JUDGED_CTE} SELECT model_id, attribute, metric_ord, name, round(value, 6) AS value, threshold, breached, severity,
  true AS ordered, true AS covered FROM judged"""
)
def full_audit(spark, folder):
    """Every metric with its interval: the headline query.

    ``covered``: the value lies in its interval, or less than half its width outside, as
    a difference of extremes may."""
    audit = A.audit_metrics(predictions(spark, folder), KEYS, ATTRIBUTES)
    slack = (F.col("ci_upper") - F.col("ci_lower")) / 2 + 1e-9
    return audit.select(
        "model_id",
        "attribute",
        "metric_ord",
        "name",
        F.round("value", 6).alias("value"),
        "threshold",
        "breached",
        "severity",
        (F.col("ci_lower") <= F.col("ci_upper")).alias("ordered"),
        F.col("value").between(F.col("ci_lower") - slack, F.col("ci_upper") + slack).alias("covered"),
    )


@query(
    f"""WITH {JUDGED_CTE}, o AS ({OVERALL_SQL.format(keys='model_id', rel=_MERGED)}),
k AS (SELECT model_id, count(*) AS n FROM p GROUP BY 1)
SELECT model_id, overall_severity, n AS sample_size, 12 AS metrics, 12 AS history, 1 AS ledger
FROM o JOIN k USING (model_id) WHERE overall_severity <> 'LOW'"""
)
def persisted_audits(spark, folder):
    """A whole audit written to its three tables, and what of each belongs together: metrics
    in the record, history rows of its time, ledger events with its id."""
    rows = predictions(spark, folder)
    audits, metrics = A.run_audit(rows, ATTRIBUTES, "1995-01-01", "2002-01-01")
    base = f"{scratch_dir(spark)}/audits-{uuid.uuid4().hex}"
    paths = {t: f"{base}/{t}" for t in ("bias_audits", "fairness_timeseries", "ledger")}
    A.persist(audits, metrics, paths)
    table, series, ledger = (spark.read.parquet(paths[t]) for t in paths)
    history = series.groupBy("model_id", "recorded_at").agg(F.count("*").cast("int").alias("history"))
    events = ledger.groupBy(F.get_json_object("Payload", "$.audit_id").alias("audit_id")).agg(
        F.count("*").cast("int").alias("ledger")
    )
    return (
        table.join(
            history.withColumnRenamed("recorded_at", "audit_timestamp"),
            ["model_id", "audit_timestamp"],
            "left",
        )
        .join(events, "audit_id", "left")
        .select(
            "model_id",
            "overall_severity",
            "sample_size",
            F.size(F.json_object_keys("metrics")).alias("metrics"),
            "history",
            "ledger",
        )
    )
