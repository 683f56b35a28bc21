"""Explanation and mitigation queries."""

import uuid

from pyspark.sql import functions as F

from evenhand.operators import cube, explain as E, mitigate as G, metrics as M
from evenhand.queries import query
from evenhand.queries.audits import METRIC_SQL
from evenhand.queries.reports import JUDGED, KEYS as QUARTER, _audit_table, _tables
from evenhand.queries.views import P, by_quarter, predictions
from evenhand.session import materialize, scratch_dir
from evenhand.sources import sinks
from evenhand.sources.commits import CommitLog
from evenhand.sources.tables import load

KEYS = ["model_id"]

_WEIGHTS = """
c AS (SELECT model_id, {a}, y_true, count(*) AS cell_n FROM p GROUP BY ALL),
w AS (SELECT *, sum(cell_n) OVER (PARTITION BY model_id, {a}) * sum(cell_n) OVER (PARTITION BY model_id, y_true)
        / (sum(cell_n) OVER (PARTITION BY model_id) * cell_n) AS weight FROM c)"""


@query(
    f"WITH {P}, {_WEIGHTS.format(a='sex')} SELECT model_id, sex, y_true, cell_n, round(weight, 6) AS weight FROM w"
)
def reweighing(spark, folder):
    out = G.reweighing(predictions(spark, folder), KEYS, ["sex"])
    return out.withColumn("weight", F.round("weight", 6))


@query(
    f"WITH {P}, {_WEIGHTS.format(a='sex, segment')} SELECT model_id, sex, segment, y_true, cell_n, round(weight, 6) AS weight FROM w"
)
def reweighing_many_groups(spark, folder):
    out = G.reweighing(predictions(spark, folder), KEYS, ["sex", "segment"])
    return out.withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {P}, {_WEIGHTS.format(a='sex')}
SELECT model_id, sex, count(*) AS n, round(sum(weight), 4) AS total_weight, round(sum(weight * y_true) / sum(weight), 6) AS base_rate
FROM p JOIN w USING (model_id, sex, y_true) GROUP BY 1, 2"""
)
def training_extract(spark, folder):
    rows = G.training_extract(predictions(spark, folder), KEYS, ["sex"])
    return rows.groupBy("model_id", "sex").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("weight"), 4).alias("total_weight"),
        F.round(F.sum(F.col("weight") * F.col("y_true")) / F.sum("weight"), 6).alias("base_rate"),
    )


@query(
    f"""WITH {P}, h AS (SELECT model_id, sex AS group_value, floor(least(greatest(y_score, 0), 1) * 1000) AS level,
    count(*) AS n, sum(y_true) AS pos FROM p GROUP BY ALL)
SELECT model_id, group_value, level / 1000 AS threshold,
  CAST(sum(n) OVER w AS BIGINT) AS selected, CAST(sum(pos) OVER w AS BIGINT) AS selected_pos,
  CAST(sum(n) OVER g AS BIGINT) AS group_n, CAST(sum(pos) OVER g AS BIGINT) AS group_pos
FROM h WINDOW w AS (PARTITION BY model_id, group_value ORDER BY level DESC), g AS (PARTITION BY model_id, group_value)"""
)
def threshold_curve(spark, folder):
    return G.threshold_curve(predictions(spark, folder), KEYS, "sex")


# Roof of a group's points at x: the best chord over x. What is maximised is straight
# between the points' places and the places where the two roofs cross.
_HULL = """
h AS (SELECT model_id, sex, y_score, count(*) AS n, sum(y_true) AS pos FROM p GROUP BY ALL),
z AS (SELECT model_id, sex, sum(n) AS gn, sum(pos) AS gp FROM h GROUP BY ALL),
c AS (SELECT model_id, sex, sum(n) OVER w AS s, sum(pos) OVER w AS hit FROM h
    WINDOW w AS (PARTITION BY model_id, sex ORDER BY y_score DESC)
  UNION ALL SELECT DISTINCT model_id, sex, 0, 0 FROM h),
tot AS (SELECT model_id, sum(gn) AS nn, sum(gp) AS pp FROM z GROUP BY 1),
pt AS (SELECT model_id, sex, s / gn AS x, (hit + (gn - gp) - (s - hit)) / nn AS y, (s - hit) / (gn - gp) AS fpr, hit / gp AS tpr, s, hit
  FROM c JOIN z USING (model_id, sex) JOIN tot USING (model_id))"""


def _roof(name, at, x, y):
    """Height of every group's roof at the places of relation ``at``."""
    return f"""{name} AS (SELECT q.model_id, a.sex, q.x, max(CASE WHEN b.{x} = a.{x} THEN greatest(a.{y}, b.{y})
    ELSE a.{y} + (b.{y} - a.{y}) * (q.x - a.{x}) / (b.{x} - a.{x}) END) AS y
  FROM {at} q JOIN pt a ON a.model_id = q.model_id AND a.{x} <= q.x JOIN pt b ON b.model_id = a.model_id AND b.sex = a.sex AND b.{x} >= q.x
  GROUP BY 1, 2, 3)"""


@query(
    f"""WITH {P}, {_HULL},
dx AS (SELECT DISTINCT model_id, x FROM pt), {_roof("dr", "dx", "x", "y")},
dp AS (SELECT model_id, max(v) AS objective FROM (SELECT model_id, x, sum(y) AS v FROM dr GROUP BY 1, 2) GROUP BY 1),
ox AS (SELECT DISTINCT model_id, fpr AS x FROM pt), {_roof("orf", "ox", "fpr", "tpr")},
od AS (SELECT model_id, x, max(y) FILTER (sex = 'Male') - max(y) FILTER (sex = 'Female') AS d FROM orf GROUP BY 1, 2),
on_ AS (SELECT *, lead(x) OVER w AS x1, lead(d) OVER w AS d1 FROM od WINDOW w AS (PARTITION BY model_id ORDER BY x)),
ex AS (SELECT model_id, x FROM ox UNION SELECT model_id, x + d / (d - d1) * (x1 - x) FROM on_ WHERE d * d1 < 0), {_roof("er", "ex", "fpr", "tpr")},
eo AS (SELECT model_id, max((y * pp + (1 - x) * (nn - pp)) / nn) AS objective
  FROM (SELECT model_id, x, min(y) AS y FROM er GROUP BY 1, 2) JOIN tot USING (model_id) GROUP BY 1)
SELECT model_id, 'demographic_parity' AS "constraint", group_value, round(objective, 6) AS objective, true AS same_rate
FROM dp, (SELECT unnest(['Female', 'Male']) AS group_value)
UNION ALL SELECT model_id, 'equalized_odds', group_value, round(objective, 6), true FROM eo, (SELECT unnest(['Female', 'Male']) AS group_value)"""
)
def fair_thresholds(spark, folder):
    """Best accuracy under each constraint, on exact scores; ``same_rate``: the chosen mix of
    thresholds gives the group the rate that all groups share."""
    curve = materialize(G.exact_curve(predictions(spark, folder), KEYS, "sex"), "curve")
    ids = [*KEYS, "group_value"]
    ends = curve.groupBy(*ids).agg(F.max("group_n").alias("gn"), F.max("group_pos").alias("gp"))
    out = None
    for constraint in ("demographic_parity", "equalized_odds"):
        choice = G.choose_thresholds(curve, KEYS, constraint).join(ends, ids)
        for side in ("a", "b"):
            at = curve.select(*ids, F.col("threshold").alias(f"threshold_{side}"), F.struct("selected", "selected_pos").alias(f"at_{side}"))
            choice = choice.join(at, [*ids, f"threshold_{side}"], "left")

        def rate(side):
            s, h = (F.coalesce(F.col(f"at_{side}.{c}"), F.lit(0)) for c in ("selected", "selected_pos"))
            return s / F.col("gn") if constraint == "demographic_parity" else (s - h) / (F.col("gn") - F.col("gp"))

        mixed = F.col("weight_a") * rate("a") + (1 - F.col("weight_a")) * rate("b")
        near = F.abs(mixed - F.col("target_rate")) < 1e-9
        part = choice.select(*KEYS, F.lit(constraint).alias("constraint"), "group_value", F.round("objective", 6).alias("objective"), near.alias("same_rate"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {P} SELECT model_id, sex, count(*) AS n, round(avg(y_pred), 6) AS rate_before, true AS near_target FROM p GROUP BY 1, 2""")
def fair_predictions(spark, folder):
    """Rates after fair thresholds lie at the shared target, but for the draw of each row."""
    rows = predictions(spark, folder)
    choice = materialize(G.choose_thresholds(G.exact_curve(rows, KEYS, "sex"), KEYS), "choice")
    fair = G.apply_thresholds(rows, choice, KEYS, "sex", "event_id")
    rates = fair.groupBy("model_id", "sex").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("y_pred"), 6).alias("rate_before"),
        F.avg("y_fair").alias("rate_after"),
    )
    noise = 4 * F.sqrt(F.lit(0.25) / F.col("n"))
    return rates.join(choice.select(*KEYS, F.col("group_value").alias("sex"), "target_rate"), [*KEYS, "sex"]).select(
        *KEYS, "sex", "n", "rate_before", (F.abs(F.col("rate_after") - F.col("target_rate")) <= noise).alias("near_target")
    )


@query(
    f"""WITH {P}, l AS (SELECT model_id, sex, list(price ORDER BY price) AS xs, count(*) AS gn FROM p GROUP BY 1, 2),
r AS (SELECT model_id, sex, price, count(*) AS n, sum(count(*)) OVER (PARTITION BY model_id, sex ORDER BY price) - count(*) AS start FROM p GROUP BY 1, 2, 3),
q AS (SELECT r.*, o.xs AS xs, least(greatest((start + n / 2) / l.gn * o.gn - 0.5, 0), o.gn - 1) AS place
  FROM r JOIN l USING (model_id, sex) JOIN l AS o ON o.model_id = r.model_id),
t AS (SELECT model_id, sex, price, n, median(xs[CAST(floor(place) AS BIGINT) + 1] * (1 - (place - floor(place)))
    + xs[CAST(ceil(place) AS BIGINT) + 1] * (place - floor(place))) AS target FROM q GROUP BY ALL)
SELECT model_id, sex, CAST(sum(n) AS BIGINT) AS n, round(sum(n * price) / sum(n), 4) AS mean_before, round(sum(n * target) / sum(n), 4) AS mean_after,
  round(max(target), 4) AS highest, round(min(target), 4) AS lowest FROM t GROUP BY 1, 2"""
)
def impact_repair(spark, folder):
    # the operator goes over its rows twice; the tables are joined for them once
    given = materialize(predictions(spark, folder).select("model_id", "sex", "price"), "priced-rows")
    rows = G.disparate_impact_repair(given, KEYS, "sex", "price")
    return rows.groupBy("model_id", "sex").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("price"), 4).alias("mean_before"),
        F.round(F.avg("price_repaired"), 4).alias("mean_after"),
        F.round(F.max("price_repaired"), 4).alias("highest"),
        F.round(F.min("price_repaired"), 4).alias("lowest"),
    )


@query(
    f"""WITH {P} SELECT model_id, sex, count(*) AS n, true AS fair, true AS both_outcomes FROM p GROUP BY 1, 2"""
)
def exponentiated_gradient(spark, folder):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    """Fair training of every model: rates per group, and whether they agree."""
    rows = VectorAssembler(inputCols=["y_score", "tax"], outputCol="features").transform(
        predictions(spark, folder).select("model_id", "event_id", "sex", "y_true", "y_score", "tax")
    )
    estimator = LogisticRegression(labelCol="_label", weightCol="_weight")
    out = None
    for (name,) in rows.select("model_id").distinct().orderBy("model_id").collect():
        data = materialize(rows.where(F.col("model_id") == name), "fair-training")
        models = G.exponentiated_gradient(estimator, data, "sex", eps=0.01)
        fair = G.randomised_predictions(models, data, "event_id")
        out = fair if out is None else out.unionByName(fair)
    rates = out.groupBy("model_id", "sex").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_fair").alias("rate")
    )
    every = out.groupBy("model_id").agg(F.avg("y_fair").alias("overall"))
    # the mixture keeps to eps; its draw per row adds sampling noise
    noise = 4 * F.sqrt(F.lit(0.25) / F.col("n"))
    return rates.join(every, "model_id").select(
        "model_id",
        "sex",
        "n",
        (F.abs(F.col("rate") - F.col("overall")) <= 0.01 + noise).alias("fair"),
        F.col("rate").between(0.05, 0.95).alias("both_outcomes"),
    )


@query(
    f"""WITH {JUDGED}, b AS (SELECT model_id, month,
  bool_or(breached) FILTER (name = 'demographic_parity_difference') AS dp, bool_or(breached) FILTER (name = 'disparate_impact_ratio') AS di,
  min(value) FILTER (name = 'disparate_impact_ratio') AS impact, bool_or(breached) FILTER (name = 'equalized_odds_difference') AS eo,
  bool_or(breached) FILTER (name = 'calibration_gap') AS cg, bool_or(breached) FILTER (name = 'intersectional_bias_score') AS ib
  FROM merged GROUP BY 1, 2),
k AS (SELECT model_id, month, CASE WHEN dp AND di THEN 1 WHEN impact < 0.65 THEN 2 WHEN eo THEN 3 WHEN cg THEN 4 WHEN ib THEN 6 END AS rule FROM b)
SELECT model_id, month,
  CASE rule WHEN 1 THEN 'Reweighing' WHEN 2 THEN 'DisparateImpactRemover' WHEN 3 THEN 'AdversarialDebiasing'
    WHEN 4 THEN 'CalibratedEqOddsPostprocessing' ELSE 'MultiGroupReweighing' END AS algorithm,
  CASE rule WHEN 3 THEN 'in-processing' WHEN 4 THEN 'post-processing' ELSE 'pre-processing' END AS stage,
  CASE rule WHEN 1 THEN 'LFR' WHEN 2 THEN 'Reweighing' WHEN 3 THEN 'PrejudiceRemover' WHEN 4 THEN 'RejectOptionClassification'
    ELSE 'AdversarialDebiasing' END AS fallback
FROM k WHERE rule IS NOT NULL"""
)
def algorithm_selection(spark, folder):
    return G.select_algorithm(_tables(spark, folder)[1], QUARTER)


@query(
    f"""WITH {JUDGED} SELECT audit_id, model_id FROM a
WHERE epoch(TIMESTAMP '2000-10-28 01:00:00') - epoch(audit_timestamp) < 7200"""
)
def fresh_audits(spark, folder):
    return G.fresh_audits(_audit_table(spark, folder), "2000-10-28 01:00:00").select("audit_id", "model_id")


# Before: the models' own cuts. After: one cut for all.
_AFTER = "CASE WHEN y_score >= 0.5 THEN 1 ELSE 0 END"


def _sided_metrics(pred):
    return f"""
{{n}}_g AS (SELECT model_id, sex AS group_value, CASE WHEN sex = 'Male' THEN 1 ELSE 0 END AS pr, count(*) AS n,
  sum({pred}) AS pred_pos, sum(y_true) AS true_pos, sum(({pred}) * y_true) AS tp,
  sum(({pred}) * (1 - y_true)) AS fp, sum((1 - ({pred})) * (1 - y_true)) AS tn, sum((1 - ({pred})) * y_true) AS fn
  FROM p GROUP BY 1, 2, 3),
{{n}}_m AS (SELECT model_id, unnest([{", ".join(f"{{{{'name': '{n}', 'value': {e}}}}}" for n, e in METRIC_SQL.items())}]) AS e
  FROM {{n}}_g GROUP BY model_id)"""


@query(
    f"""WITH {P}, {_sided_metrics('y_pred').format(n='b')}, {_sided_metrics(_AFTER).format(n='c')},
j AS (SELECT b_m.model_id, b_m.e.name AS name, b_m.e.value AS vb, c_m.e.value AS va
  FROM b_m JOIN c_m ON b_m.model_id = c_m.model_id AND b_m.e.name = c_m.e.name),
o AS (SELECT *, abs(vb - CASE WHEN name IN ('disparate_impact_ratio', 'statistical_parity_subgroup_lift') THEN 1 ELSE 0 END) AS ob,
  abs(va - CASE WHEN name IN ('disparate_impact_ratio', 'statistical_parity_subgroup_lift') THEN 1 ELSE 0 END) AS oa FROM j)
SELECT model_id, name, round(vb, 6) AS value_before, round(va, 6) AS value_after,
  round(CASE WHEN ob > 0 THEN 100.0 * (ob - oa) / ob ELSE 0 END, 4) AS improvement_pct FROM o"""
)
def fairness_improvement(spark, folder):
    rows = predictions(spark, folder)

    def long(data):
        groups = cube.confusion_cube(data, KEYS, ["sex"])
        sided = cube.with_sides(groups, cube.audit_frame(groups, KEYS), KEYS)
        wide = M.group_metrics(sided, KEYS)
        names = [m.name for m in M.registered()]
        entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
        return wide.select(*KEYS, F.inline(entries))

    after = rows.withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))
    return G.improvement(long(rows), long(after), KEYS).select(
        "model_id",
        "name",
        F.round("value_before", 6).alias("value_before"),
        F.round("value_after", 6).alias("value_after"),
        F.round("improvement_pct", 4).alias("improvement_pct"),
    )


# One mitigation per model and quarter, judged on the rows of that quarter.
_LOG = f"""{P},
q AS (SELECT model_id, strftime(date_trunc('quarter', ts), '%Y-%m') AS month, sex, y_true, y_pred, {_AFTER} AS y_new FROM p),
r AS (SELECT model_id, month, avg(y_pred) FILTER (sex = 'Male') AS bp, avg(y_pred) FILTER (sex = 'Female') AS bu,
  avg(y_new) FILTER (sex = 'Male') AS ap, avg(y_new) FILTER (sex = 'Female') AS au,
  avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS accuracy_before, avg(CASE WHEN y_new = y_true THEN 1.0 ELSE 0.0 END) AS accuracy_after
  FROM q GROUP BY 1, 2),
log AS (SELECT *, model_id || '-' || month AS mitigation_id, strptime(month || '-15', '%Y-%m-%d') AS triggered_at,
  bu / greatest(bp, 1e-10) AS di_b, au / greatest(ap, 1e-10) AS di_a, abs(bp - bu) AS dp_b, abs(ap - au) AS dp_a,
  accuracy_after - accuracy_before AS accuracy_delta FROM r)"""


def mitigation_log(spark, folder):
    rows = by_quarter(spark, folder).withColumn("y_new", (F.col("y_score") >= 0.5).cast("int"))
    male = F.col("sex") == "Male"

    def rate(c, flag):
        return F.avg(F.when(flag, F.col(c)))

    def right(c):
        return F.avg((F.col(c) == F.col("y_true")).cast("double"))

    rates = rows.groupBy("model_id", "month").agg(
        rate("y_pred", male).alias("bp"),
        rate("y_pred", ~male).alias("bu"),
        rate("y_new", male).alias("ap"),
        rate("y_new", ~male).alias("au"),
        right("y_pred").alias("accuracy_before"),
        right("y_new").alias("accuracy_after"),
    )

    def maps(p, u):
        return F.create_map(
            F.lit("disparate_impact_ratio"),
            F.col(u) / F.greatest(F.col(p), F.lit(1e-10)),
            F.lit("demographic_parity_difference"),
            F.abs(F.col(p) - F.col(u)),
        )

    return rates.select(
        "model_id",
        "month",
        F.concat("model_id", F.lit("-"), "month").alias("mitigation_id"),
        F.to_timestamp(F.concat("month", F.lit("-15"))).alias("triggered_at"),
        "accuracy_before",
        "accuracy_after",
        maps("bp", "bu").alias("metrics_before"),
        maps("ap", "au").alias("metrics_after"),
    )


@query(
    f"""WITH {_LOG} SELECT mitigation_id, model_id, strftime(triggered_at, '%Y-%m-%d') AS day, round(accuracy_delta, 6) AS accuracy_delta,
  round(di_a, 6) AS impact_after, true AS no_error FROM log WHERE model_id = 'model-o' ORDER BY triggered_at DESC, mitigation_id LIMIT 5"""
)
def mitigation_table(spark, folder):
    """The log written to its table, once though committed twice, and a model's newest rows."""
    log = CommitLog(spark, f"{scratch_dir(spark)}/mitigations-{uuid.uuid4().hex}")
    rows = sinks.mitigation_rows(mitigation_log(spark, folder)).withColumn("date", F.to_date("triggered_at"))
    for _ in range(2):
        log.commit("mitigations", {"mitigation_log": rows}, {"mitigation_log": ["date"]})
    found = sinks.mitigation_lookup(log.read("mitigation_log"), model_id="model-o", newest=5)
    return found.select(
        "mitigation_id",
        "model_id",
        F.date_format("triggered_at", "yyyy-MM-dd").alias("day"),
        F.round("accuracy_delta", 6).alias("accuracy_delta"),
        F.round(F.get_json_object("metrics_after", "$.disparate_impact_ratio").cast("double"), 6).alias("impact_after"),
        F.col("error_message").isNull().alias("no_error"),
    )


@query(
    f"""WITH {_LOG}
SELECT mitigation_id, round(accuracy_delta, 6) AS accuracy_delta, accuracy_delta < -0.15 AS severe_degradation,
  (abs(1 - di_a) < abs(1 - di_b) OR dp_a < dp_b) AS fairness_improved,
  accuracy_delta < -0.15 OR NOT (abs(1 - di_a) < abs(1 - di_b) OR dp_a < dp_b) AS roll_back,
  CASE WHEN accuracy_delta < -0.15 THEN
      'Undone: an unacceptable accuracy drop, ' || format('{{:.2f}}', abs(accuracy_delta) * 100) || '% with 15.00% allowed'
    WHEN NOT (abs(1 - di_a) < abs(1 - di_b) OR dp_a < dp_b) THEN 'Undone: it failed to improve impact ratio or parity'
    ELSE 'Kept' END AS reason
FROM log"""
)
def rollback_guard(spark, folder):
    return G.rollback_guard(mitigation_log(spark, folder)).select(
        "mitigation_id",
        F.round("accuracy_delta", 6).alias("accuracy_delta"),
        "severe_degradation",
        "fairness_improved",
        "roll_back",
        "reason",
    )


@query(
    f"WITH {_LOG} SELECT mitigation_id, accuracy_before - accuracy_after <= 0.02 AS gate_passed FROM log"
)
def accuracy_gate(spark, folder):
    return G.accuracy_gate(mitigation_log(spark, folder)).select("mitigation_id", "gate_passed")


@query(
    f"""WITH {_LOG} SELECT mitigation_id, CASE WHEN accuracy_delta < 0 THEN 'failed' ELSE 'success' END AS status,
  strftime(triggered_at + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS at FROM log"""
)
def mitigation_status(spark, folder):
    log = mitigation_log(spark, folder)
    end = F.when(F.col("accuracy_after") < F.col("accuracy_before"), "failed").otherwise("success")
    steps = F.array(
        F.struct(F.lit("queued").alias("status"), F.lit(0).alias("h")),
        F.struct(F.lit("in_progress").alias("status"), F.lit(1).alias("h")),
        F.struct(end.alias("status"), F.lit(2).alias("h")),
    )
    rows = log.select("mitigation_id", "triggered_at", F.inline(steps)).select(
        "mitigation_id",
        "status",
        (F.col("triggered_at") + F.make_dt_interval(hours=F.col("h"))).alias("recorded_at"),
    )
    return G.latest_status(rows).select(
        "mitigation_id", "status", F.date_format("recorded_at", "yyyy-MM-dd HH:mm").alias("at")
    )


@query(
    f"""WITH {_LOG}, pt AS (SELECT model_id, ts AS stamp, count(*) AS n FROM p GROUP BY 1, 2)
SELECT model_id, strftime(stamp, '%Y-%m-%d') AS day,
  (SELECT arg_max(mitigation_id, triggered_at) FROM log WHERE log.model_id = pt.model_id AND triggered_at <= stamp) AS mitigation_id
FROM pt"""
)
def mitigation_overlay(spark, folder):
    days = predictions(spark, folder).groupBy("model_id", F.col("ts").alias("audit_timestamp")).agg(
        F.count(F.lit(1)).alias("n")
    )
    audits = days.withColumn("audit_id", F.concat("model_id", F.col("audit_timestamp").cast("string")))
    out = G.mitigation_overlay(audits, mitigation_log(spark, folder))
    return out.select(
        "model_id", F.date_format("audit_timestamp", "yyyy-MM-dd").alias("day"), "mitigation_id"
    )


@query(
    f"""WITH {_LOG}
SELECT mitigation_id, 'disparate_impact_ratio' AS name, round(di_b, 6) AS value_before, round(di_a, 6) AS value_after FROM log
UNION ALL SELECT mitigation_id, 'demographic_parity_difference', round(dp_b, 6), round(dp_a, 6) FROM log"""
)
def mitigation_timeline(spark, folder):
    from evenhand.plans.views import mitigation_timeline as timeline

    return timeline(mitigation_log(spark, folder)).select(
        "mitigation_id",
        "name",
        F.round("value_before", 6).alias("value_before"),
        F.round("value_after", 6).alias("value_after"),
    )


_SHIFTS = [0.01, 0.12, 0.23, 0.34, 0.45, 0.56, 0.67, 0.78, 0.89, 1.0]
_CUTS = [0.3, 0.4, 0.5, 0.6, 0.7]
_CANDIDATES = f"""{P},
pts AS (SELECT model_id, sex = 'Male' AS is_p, y_score, y_true, count(*) AS n FROM p GROUP BY ALL),
mn AS (SELECT model_id, sum(n * y_score) FILTER (is_p) / sum(n) FILTER (is_p) AS mp,
  sum(n * y_score) FILTER (NOT is_p) / sum(n) FILTER (NOT is_p) AS mu FROM pts GROUP BY 1),
tr AS (SELECT pts.*, shift, cut, y_score + CASE WHEN is_p THEN 0.0 ELSE shift * (mp - mu) END >= cut AS picked
  FROM pts JOIN mn USING (model_id), (SELECT CAST(unnest({_SHIFTS}) AS DOUBLE) AS shift), (SELECT CAST(unnest({_CUTS}) AS DOUBLE) AS cut)),
sm AS (SELECT model_id, shift, cut, sum(n) FILTER (picked = (y_true = 1)) / sum(n) AS accuracy,
  abs(coalesce(sum(n) FILTER (is_p AND picked), 0) / sum(n) FILTER (is_p)
    - coalesce(sum(n) FILTER (NOT is_p AND picked), 0) / sum(n) FILTER (NOT is_p)) AS gap,
  abs(coalesce(sum(n) FILTER (is_p AND picked AND y_true = 1), 0) / sum(n) FILTER (is_p AND y_true = 1)
    - coalesce(sum(n) FILTER (NOT is_p AND picked AND y_true = 1), 0) / sum(n) FILTER (NOT is_p AND y_true = 1)) AS miss
  FROM tr GROUP BY 1, 2, 3),
cand AS (SELECT model_id, shift, cut, greatest(gap - 0.10, 0) + greatest(miss - 0.05, 0) AS violations, accuracy FROM sm)"""


@query(
    f"WITH {_CANDIDATES} SELECT model_id, shift, cut, round(violations, 6) AS violations, round(accuracy, 6) AS accuracy FROM cand"
)
def candidate_outcomes(spark, folder):
    out = G.candidate_outcomes(predictions(spark, folder), KEYS, "sex", "Male", _SHIFTS, _CUTS)
    return out.withColumn("violations", F.round("violations", 6)).withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query(
    f"""WITH {_CANDIDATES}, r AS (SELECT model_id, shift, cut, round(violations, 6) AS violations, round(accuracy, 6) AS accuracy FROM cand)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.model_id = r.model_id AND o.violations <= r.violations
  AND o.accuracy >= r.accuracy AND (o.violations < r.violations OR o.accuracy > r.accuracy))"""
)
def pareto_front(spark, folder):
    return G.pareto_front(candidate_outcomes(spark, folder), KEYS)


@query(
    f"""WITH {P}, g AS (SELECT model_id, model_version, sex AS group_value, CASE WHEN sex = 'Male' THEN 1 ELSE 0 END AS pr, count(*) AS n,
  sum(y_pred) AS pred_pos, sum(y_true) AS true_pos, sum(y_pred * y_true) AS tp, sum(y_pred * (1 - y_true)) AS fp,
  sum((1 - y_pred) * (1 - y_true)) AS tn, sum((1 - y_pred) * y_true) AS fn FROM p GROUP BY 1, 2, 3, 4),
m AS (SELECT model_id, model_version, {", ".join(f"{e} AS {n}" for n, e in METRIC_SQL.items())} FROM g GROUP BY 1, 2),
b AS (SELECT model_id, model_version, CAST((demographic_parity_difference > 0.10) AS INT) + CAST((equalized_odds_difference > 0.08) AS INT)
  + CAST((equal_opportunity_difference > 0.05) AS INT) + CAST((disparate_impact_ratio < 0.80) AS INT)
  + CAST((average_odds_difference > 0.07) AS INT) + CAST((statistical_parity_subgroup_lift > 1.25) AS INT)
  + CAST((predictive_parity_difference > 0.08) AS INT) + CAST((counterfactual_fairness > 0.06) AS INT) AS nb FROM m),
ac AS (SELECT model_id, model_version, avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY 1, 2),
j AS (SELECT * FROM b JOIN ac USING (model_id, model_version)),
w AS (SELECT model_id, max(nb) FILTER (model_version = 'v1') AS ba, max(nb) FILTER (model_version = 'v2') AS bb,
  max(acc) FILTER (model_version = 'v1') AS aa, max(acc) FILTER (model_version = 'v2') AS ab FROM j GROUP BY 1)
SELECT model_id, CAST(ba AS BIGINT) AS breached_a, CAST(bb AS BIGINT) AS breached_b, round(aa, 6) AS accuracy_a, round(ab, 6) AS accuracy_b,
  CASE WHEN bb <= ba AND aa - ab <= 0.02 THEN 'pass' ELSE 'fail' END AS ab_result FROM w"""
)
def version_comparison(spark, folder):
    rows = predictions(spark, folder)
    keys = ["model_id", "model_version"]
    groups = cube.confusion_cube(rows, keys, ["sex"])
    sided = cube.with_sides(groups, cube.audit_frame(groups, keys), keys)
    wide = M.group_metrics(sided, keys).withColumn("p_value", F.lit(0.0))
    judged = M.long_metrics(wide, keys)
    out = G.compare_versions(judged, G.accuracy(rows, keys), KEYS, "v1", "v2")
    return out.withColumn("accuracy_a", F.round("accuracy_a", 6)).withColumn(
        "accuracy_b", F.round("accuracy_b", 6)
    )


# --- explanation ---------------------------------------------------------------

# A fixed linear model over the line items.
_COEFFICIENTS = {"price": 0.00002, "discount": -3.0, "tax": 5.0, "quantity": 0.04}
_ATTRIBUTION = f"""{P},
mn AS (SELECT model_id, {", ".join(f"avg({c}) AS m_{c}" for c in _COEFFICIENTS)} FROM p GROUP BY 1),
attr AS (SELECT model_id, sex, {", ".join(f"{w!r} * ({c} - m_{c}) AS a_{c}" for c, w in _COEFFICIENTS.items())} FROM p JOIN mn USING (model_id)),
lg AS ({" UNION ALL ".join(f"SELECT model_id, sex, {i} AS feature_ord, '{c}' AS feature, a_{c} AS value FROM attr" for i, c in enumerate(_COEFFICIENTS))})"""


def _attribution(spark, folder):
    return E.linear_attribution(predictions(spark, folder), KEYS, _COEFFICIENTS, kept=["sex"])


@query(
    f"""WITH {_ATTRIBUTION}, i AS (SELECT model_id, feature, avg(abs(value)) AS importance FROM lg GROUP BY 1, 2)
SELECT model_id, feature, round(importance, 6) AS importance,
  CAST(row_number() OVER (PARTITION BY model_id ORDER BY importance DESC) AS INTEGER) AS rank FROM i"""
)
def feature_importance(spark, folder):
    out = E.importance(_attribution(spark, folder), KEYS)
    return out.select("model_id", "feature", F.round("importance", 6).alias("importance"), "rank")


@query(
    f"""WITH {_ATTRIBUTION} SELECT model_id, sex AS group_value, feature, round(avg(abs(value)), 6) AS importance FROM lg GROUP BY 1, 2, 3"""
)
def group_importance(spark, folder):
    out = E.group_importance(_attribution(spark, folder), KEYS, "sex")
    return out.withColumn("importance", F.round("importance", 6))


@query(
    f"""WITH {_ATTRIBUTION}, i AS (SELECT model_id, feature, avg(abs(value)) AS importance FROM lg GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY importance DESC) AS rank FROM i),
t AS (SELECT model_id, string_agg(feature, ',' ORDER BY rank) AS top_features, max(importance) FILTER (feature = 'tax') AS si,
  max(rank) FILTER (feature = 'tax') AS sr FROM r WHERE rank <= 5 GROUP BY 1)
SELECT model_id, any_value(top_features) AS top_features, round(any_value(si), 6) AS sensitive_importance, CAST(any_value(sr) AS INTEGER) AS sensitive_rank,
  CAST(count(*) / 4 AS BIGINT) AS rows_explained, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS std, round(max(abs(value)), 6) AS max_abs
FROM lg JOIN t USING (model_id) GROUP BY model_id"""
)
def attribution_summary(spark, folder):
    out = E.attribution_summary(_attribution(spark, folder), KEYS, len(_COEFFICIENTS), "tax")
    return out.select(
        "model_id",
        F.array_join("top_features", ",").alias("top_features"),
        F.round("sensitive_importance", 6).alias("sensitive_importance"),
        "sensitive_rank",
        "rows_explained",
        (F.round("mean", 6) + 0.0).alias("mean"),
        F.round("std", 6).alias("std"),
        F.round("max_abs", 6).alias("max_abs"),
    )


def _shapley_rows(spark, folder):
    return load(spark, folder, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 10000).alias("balance"),
        (F.col("c_nationkey") / 25).alias("nation"),
        (F.col("c_custkey") % 7 / 7).alias("part"),
    )


def _shapley_score(df):
    z = 2 * F.col("balance") - F.col("nation") * F.col("part")
    return df.withColumn("output", 1 / (1 + F.exp(-z)))


@query()
def shapley_attribution(spark, folder):
    rows = _shapley_rows(spark, folder)
    out = E.shapley_attribution(
        rows,
        "c_custkey",
        ["balance", "nation", "part"],
        _shapley_score,
        rows,
    )
    return out.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("value")).alias("importance")
    )


_CF = """
w AS (SELECT event_id, model_id, quantity, tax, discount FROM p WHERE 0.04 * quantity + 5.0 * tax - 3.0 * discount < 1.0),
ch AS (SELECT * FROM (VALUES (0, 0.1), (1, 0.2), (2, 0.3), (3, -0.1), (4, -0.2), (5, -0.3)) c(cj, d)),
tr AS (SELECT event_id, model_id, 0 AS fo, cj, 'quantity' AS feature, quantity AS fv, quantity * (1 + CAST(d AS DOUBLE)) AS tv,
    0.04 * (quantity * (1 + CAST(d AS DOUBLE))) + 5.0 * tax - 3.0 * discount AS z FROM w, ch
  UNION ALL SELECT event_id, model_id, 1, cj, 'tax', tax, tax * (1 + CAST(d AS DOUBLE)),
    0.04 * quantity + 5.0 * (tax * (1 + CAST(d AS DOUBLE))) - 3.0 * discount FROM w, ch
  UNION ALL SELECT event_id, model_id, 2, cj, 'discount', discount, discount * (1 + CAST(d AS DOUBLE)),
    0.04 * quantity + 5.0 * tax - 3.0 * (discount * (1 + CAST(d AS DOUBLE))) FROM w, ch),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY fo, cj) AS found_no FROM tr WHERE z >= 1.0)"""


def _counterfactuals(spark, folder):
    z = 0.04 * F.col("quantity") + 5.0 * F.col("tax") - 3.0 * F.col("discount")
    rows = predictions(spark, folder).withColumn("y_pred", (z >= 1.0).cast("int"))
    return E.counterfactuals(
        rows,
        "event_id",
        ["quantity", "tax", "discount"],
        lambda df: df.withColumn("prediction", (z >= 1.0).cast("int")),
    )


@query(
    f"""WITH {P}, {_CF} SELECT event_id, CAST(found_no AS INTEGER) AS found_no, feature, round(fv, 4) AS from_value, round(tv, 4) AS to_value,
  round(tv - fv, 4) AS delta, 1 AS n_changes, 1 AS predicted_outcome FROM k WHERE found_no <= 5"""
)
def counterfactual_grid(spark, folder):
    return _counterfactuals(spark, folder)


@query(
    f"""WITH {P}, {_CF}, c AS (SELECT feature, count(*) AS times FROM k WHERE found_no <= 5 GROUP BY 1)
SELECT feature, times, CAST(row_number() OVER (ORDER BY times DESC, feature) AS INTEGER) AS rank FROM c QUALIFY rank <= 3"""
)
def changed_features(spark, folder):
    return E.change_summary(_counterfactuals(spark, folder))


@query(
    """WITH n AS (SELECT c_custkey, c_acctbal AS balance, greatest(c_acctbal, 0) AS b2, c_nationkey AS nation, c_nationkey % 10 AS n2 FROM customer)
SELECT c_custkey, CAST((balance <> b2) AS INT) + CAST((nation <> n2) AS INT) AS n_changes,
  concat_ws(';', CASE WHEN balance <> b2 THEN 'balance' END, CASE WHEN nation <> n2 THEN 'nation' END) AS changed,
  round(coalesce(CASE WHEN balance <> b2 THEN b2 - balance END, 0) + coalesce(CASE WHEN nation <> n2 THEN n2 - nation END, 0), 4) AS total_delta
FROM n"""
)
def change_description(spark, folder):
    pairs = load(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("balance"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("balance_new"),
        F.col("c_nationkey").alias("nation"),
        (F.col("c_nationkey") % 10).alias("nation_new"),
    )
    out = E.describe_changes(pairs, "c_custkey", ["balance", "nation"])
    deltas = F.aggregate("changes", F.lit(0.0), lambda a, c: a + c["delta"])
    return out.select(
        "c_custkey",
        "n_changes",
        F.array_join(F.transform("changes", lambda c: c["feature"]), ";").alias("changed"),
        F.round(deltas, 4).alias("total_delta"),
    )


@query("SELECT c_custkey, 50 AS copies, true AS in_range FROM customer")
def background_copies(spark, folder):
    rows = load(spark, folder, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_acctbal").alias("given")
    )
    # the planner takes the copies for as few as the rows and would broadcast them
    given = rows.select("c_custkey", "given").hint("shuffle_hash")
    out = E.background_around(
        rows,
        "c_custkey",
        ["balance"],
        lambda df: df.join(given, "c_custkey").withColumn(
            "prediction",
            F.abs(F.col("balance") - F.col("given")) <= 0.5 * F.abs("given") + 1e-9,
        ),
    )
    return out.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("copies"), F.bool_and("prediction").alias("in_range")
    )


# With one background row, a row's values add up to its output less the background's.
@query(
    """WITH x AS (SELECT c_custkey, c_acctbal / 10000 AS b, c_nationkey / 25 AS n, c_custkey % 7 / 7 AS q FROM customer),
y AS (SELECT c_custkey, 1 / (1 + exp(-(2 * b - n * q))) AS o FROM x)
SELECT c_custkey, round(o - (SELECT arg_min(o, c_custkey) FROM y), 6) + 0.0 AS total FROM y"""
)
def shapley_total(spark, folder):
    rows = _shapley_rows(spark, folder)
    background = rows.orderBy("c_custkey").limit(1)
    out = E.shapley_attribution(
        rows, "c_custkey", ["balance", "nation", "part"], _shapley_score, background, permutations=4
    )
    return out.groupBy("c_custkey").agg((F.round(F.sum("value"), 6) + 0.0).alias("total"))
