"""Queries over quarterly audits: records, look-ups, roll-ups and report text."""

from pyspark.sql import functions as F

from evenhand.operators import cube, report as C, severity as V
from evenhand.operators.slices import demographic_slices
from evenhand.plans import audit as A, views
from evenhand.queries import query
from evenhand.queries.audits import JUDGED_CTE, OVERALL_SQL
from evenhand.queries.views import ATTRIBUTES, PREDICTIONS_SQL, QUARTERLY, P, by_quarter, predictions
from evenhand.schemas import VERDICTS
from evenhand.session import materialize
from evenhand.sources import sinks
from evenhand.sources.tables import load, query as run_sql

KEYS = ["model_id", "month"]
# Twelve metrics per model, quarter and protected attribute. Quarters under the minimum
# sample are not audited. ``every`` has them all, ``merged`` what the record keeps by name:
# those of the last attribute. ``sq`` are the groups of the audited quarters.
_SPLIT = "string_split(model_id, '~')[1] AS model_id, string_split(model_id, '~')[2] AS month"
JUDGED = f"""{JUDGED_CTE.replace(PREDICTIONS_SQL, QUARTERLY)},
every AS (SELECT {_SPLIT}, judged.* EXCLUDE (model_id), strptime(string_split(model_id, '~')[2] || '-28', '%Y-%m-%d') AS audit_timestamp
  FROM judged JOIN f USING (model_id, attribute, attribute_ord) WHERE sample_size >= 100),
merged AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY model_id, month, name ORDER BY attribute_ord DESC) = 1),
sq AS (SELECT {_SPLIT}, s.* EXCLUDE (model_id) FROM s WHERE sample_size >= 100),
ov AS ({OVERALL_SQL.format(keys='model_id, month', rel='merged')}),
a AS (SELECT ov.model_id, ov.month, ov.overall_severity, ov.n_metrics, ov.n_breached, v.sample_size,
   substr(sha256(concat_ws('|', ov.model_id, ov.month, ov.month || '-28 00:00:00')), 1, 32) AS audit_id,
   strptime(ov.month || '-28', '%Y-%m-%d') AS audit_timestamp, v.model_version
 FROM ov JOIN (SELECT {_SPLIT}, count(*) AS sample_size, arg_min(model_version, (ts, event_id)) AS model_version FROM p GROUP BY 1, 2) v
 USING (model_id, month))"""


def _audits(spark, folder):
    """(nested audits, judged metrics, slices) of all models and quarters, written once for
    the query that asks: twelve metrics over both attributes."""
    rows = by_quarter(spark, folder)
    lattice = A.audit_lattice(rows, KEYS, ATTRIBUTES)
    metrics = A.audit_metrics(rows, KEYS, ATTRIBUTES, intervals=False, lattice=lattice)
    metrics = materialize(metrics.withColumn("audit_timestamp", _stamp()), "quarter-metrics")
    header = (
        lattice.header()
        .where("sample_size >= 100")
        .withColumn("audit_timestamp", _stamp())
        .withColumn("window_start", F.to_timestamp(F.concat("month", F.lit("-01"))))
        .withColumn("window_end", F.add_months(F.col("window_start"), 3).cast("timestamp"))
    )
    slices = materialize(demographic_slices(lattice.groups, KEYS), "quarter-slices")
    audits = materialize(A.audit_results(metrics, slices, header, KEYS, ATTRIBUTES), "quarter-audits")
    return audits, metrics, slices


def _tables(spark, folder):
    """As ``_audits``, with the metrics merged by name as in the record."""
    audits, metrics, slices = _audits(spark, folder)
    return audits, V.last_attribute_wins(metrics, KEYS), slices


def _stamp():
    return F.to_timestamp(F.concat("month", F.lit("-28")))


def _audit_table(spark, folder):
    return sinks.audit_rows(_tables(spark, folder)[0])


def _series(spark, folder):
    return A.timeseries(_tables(spark, folder)[1], F.col("audit_timestamp"))


_DAY = "strftime(audit_timestamp, '%Y-%m-%d')"


def _day(c="audit_timestamp"):
    return F.date_format(c, "yyyy-MM-dd")


@query(
    f"""WITH {JUDGED}, b AS (SELECT model_id, month, string_agg(name, ',' ORDER BY metric_ord) FILTER (breached) AS names
  FROM merged GROUP BY 1, 2)
SELECT audit_id, model_id, model_version, {_DAY} AS day, sample_size, overall_severity, n_breached,
  coalesce(names, '') AS breached_metrics FROM a JOIN b USING (model_id, month)"""
)
def audit_records(spark, folder):
    audits = _tables(spark, folder)[0]
    return audits.select(
        "audit_id",
        "model_id",
        "model_version",
        _day().alias("day"),
        "sample_size",
        "overall_severity",
        "n_breached",
        F.array_join(sinks.breached_names(), ",").alias("breached_metrics"),
    )


@query(
    f"""WITH {JUDGED} SELECT audit_id, overall_severity, round(value, 6) AS impact FROM a JOIN merged USING (model_id, month)
WHERE name = 'disparate_impact_ratio'"""
)
def json_metric_extract(spark, folder):
    table = _audit_table(spark, folder)
    return table.select("audit_id", "overall_severity", C.metric_value("disparate_impact_ratio").alias("impact"))


@query(
    f"""WITH {JUDGED} SELECT audit_id, attribute, group_value, round(pred_pos / n, 6) AS pos_rate
FROM a JOIN sq USING (model_id, month)"""
)
def slice_unnest(spark, folder):
    return views.slice_drill_down(_audit_table(spark, folder))


@query(
    f"""WITH {JUDGED} SELECT audit_id, {_DAY} AS day, overall_severity FROM a
WHERE model_id = 'model-o' AND CAST(audit_timestamp AS DATE) BETWEEN DATE '1997-02-28' AND DATE '1999-11-28'
ORDER BY audit_timestamp DESC LIMIT 100"""
)
def audit_range(spark, folder):
    out = C.audit_range(_audit_table(spark, folder), "model-o", "1997-02-28", "1999-11-28")
    return out.select("audit_id", _day().alias("day"), "overall_severity")


@query(
    f"""WITH {JUDGED} SELECT audit_id, model_id, overall_severity FROM a
WHERE audit_id = substr(sha256('model-o|1998-04|1998-04-28 00:00:00'), 1, 32) LIMIT 1"""
)
def audit_lookup(spark, folder):
    import hashlib

    wanted = hashlib.sha256(b"model-o|1998-04|1998-04-28 00:00:00").hexdigest()[:32]
    return C.point_lookup(_audit_table(spark, folder), audit_id=wanted).select(
        "audit_id", "model_id", "overall_severity"
    )


@query(
    f"""WITH {JUDGED} SELECT model_id, name AS metric_name, round(value, 6) AS metric_value, severity, {_DAY} AS day FROM merged"""
)
def metric_timeseries(spark, folder):
    return _series(spark, folder).select(
        "model_id", "metric_name", "metric_value", "severity", _day("recorded_at").alias("day")
    )


@query(
    f"""WITH {JUDGED} SELECT model_id, name AS metric_name, round(value, 6) AS metric_value, {_DAY} AS day FROM merged
WHERE model_id = 'model-o' AND name IN ('demographic_parity_difference', 'calibration_gap')
  AND audit_timestamp >= TIMESTAMP '2000-12-31' - INTERVAL 365 DAY"""
)
def series_filter(spark, folder):
    names = ("demographic_parity_difference", "calibration_gap")
    out = C.series_filter(_series(spark, folder), "model-o", "2000-12-31", names, 365)
    return out.select("model_id", "metric_name", "metric_value", _day("recorded_at").alias("day"))


_LATEST = f"""{JUDGED}, lt AS (SELECT * FROM merged
  QUALIFY row_number() OVER (PARTITION BY model_id, name ORDER BY audit_timestamp DESC) = 1)"""


@query(
    f"WITH {_LATEST} SELECT model_id, name AS metric_name, round(value, 6) AS metric_value, severity, {_DAY} AS day FROM lt"
)
def latest_metric(spark, folder):
    return C.latest_metrics(_series(spark, folder)).select(
        "model_id", "metric_name", "metric_value", "severity", _day("recorded_at").alias("day")
    )


@query(
    f"""WITH {_LATEST}, t AS (SELECT *, regexp_replace(CAST(CAST(round(value, 6) AS DECIMAL(30, 6)) AS VARCHAR), '0+$', '') AS v FROM lt)
SELECT '# HELP bias_metric Current bias metric value' AS line
UNION ALL SELECT '# TYPE bias_metric gauge'
UNION ALL SELECT 'bias_metric{{model_id="' || model_id || '",metric="' || name || '",severity="' || severity || '"}} ' ||
  v || CASE WHEN ends_with(v, '.') THEN '0' ELSE '' END FROM t"""
)
def exposition_text(spark, folder):
    recent = C.recent_series(_series(spark, folder), "2001-12-01", hours=24 * 5000)
    return C.exposition(C.latest_metrics(recent)).select("line")


_RANK = "list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'PASS'], overall_severity)"
_VISITED = f"""{JUDGED}, vis AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY audit_timestamp DESC, audit_id) AS visit FROM a
  QUALIFY visit <= 100)"""


@query(
    f"""WITH {_VISITED}
SELECT model_id, arg_min(overall_severity, {_RANK}) AS worst_severity, CAST(sum(sample_size) AS BIGINT) AS total_sample_size,
  count(*) AS n_audits, string_agg(audit_id, ',' ORDER BY visit) AS audit_ids, arg_max(model_version, visit) AS model_version
FROM vis GROUP BY model_id"""
)
def compliance_rollup(spark, folder):
    header, _, _ = C.compliance_rollup(_audit_table(spark, folder))
    return header.withColumn("audit_ids", F.array_join("audit_ids", ","))


@query(
    f"""WITH {_VISITED}, r AS (SELECT j.model_id, name, value, breached, j.severity,
  row_number() OVER (PARTITION BY j.model_id, name ORDER BY breached DESC, visit) AS k
  FROM merged j JOIN vis USING (model_id, month))
SELECT model_id, name, round(value, 6) AS value, breached, severity FROM r WHERE k = 1"""
)
def compliance_metrics(spark, folder):
    _, metrics, _ = C.compliance_rollup(_audit_table(spark, folder))
    return metrics.select("model_id", "name", "value", "breached", "severity")


@query(
    f"""WITH {_VISITED}, sl AS (SELECT sq.model_id, attribute, attribute_ord, group_value, n, round(pred_pos / n, 6) AS pos_rate, visit,
    row_number() OVER (PARTITION BY sq.model_id, attribute, group_value ORDER BY visit) AS k
  FROM sq JOIN vis USING (model_id, month)),
o AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY visit, attribute_ord, group_value) AS slice_no FROM sl WHERE k = 1)
SELECT model_id, attribute, group_value, CAST(slice_no AS INTEGER) AS slice_no, n AS count, pos_rate FROM o WHERE slice_no <= 20"""
)
def compliance_slices(spark, folder):
    _, _, slices = C.compliance_rollup(_audit_table(spark, folder))
    return slices.drop("metrics")


@query(
    f"""WITH {JUDGED}, r(rule_no, regulation, rule_metric, relevant_metric) AS (VALUES
  {", ".join(f"({i + 1}, '{r}', '{m}', '{d}')" for i, (r, m, d) in enumerate(C.REGULATIONS))})
SELECT model_id, month, attribute, rule_no, regulation, relevant_metric,
  CASE WHEN breached THEN 'NON-COMPLIANT' ELSE 'COMPLIANT' END AS status
FROM r JOIN every ON rule_metric = name"""
)
def regulatory_status(spark, folder):
    """Per protected attribute, so that none hides another's breach."""
    return C.regulatory_status(_audits(spark, folder)[1], [*KEYS, "attribute"])


_TITLE = (
    "array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
)


@query(
    f"""WITH {JUDGED} SELECT model_id, month, attribute, {_TITLE.format(c='name')} AS metric, format('{{:.4f}}', value) AS value,
  format('{{:.4f}}', threshold) AS threshold, CASE WHEN breached THEN '✗ YES' ELSE '✓ PASS' END AS breach, severity,
  format('{{:.4f}}', p_value) AS p_value FROM every"""
)
def metric_table(spark, folder):
    """Per protected attribute."""
    return C.metric_table(_audits(spark, folder)[1], [*KEYS, "attribute"])


@query(
    f"""WITH {JUDGED}, t AS (SELECT *, row_number() OVER (PARTITION BY model_id, month ORDER BY attribute_ord, group_value) AS row_no
  FROM sq)
SELECT model_id, month, CAST(row_no AS INTEGER) AS row_no, attribute || '=' || group_value AS group_name, CAST(n AS VARCHAR) AS group_count,
  format('{{:.3f}}', pred_pos / n) AS positive_rate, format('{{:.3f}}', tp / greatest(tp + fn, 1)) AS tpr,
  format('{{:.3f}}', fp / greatest(fp + tn, 1)) AS fpr, format('{{:.3f}}', tp / greatest(tp + fp, 1)) AS precision
FROM t WHERE row_no <= 15"""
)
def slice_table(spark, folder):
    audits, _, slices = _tables(spark, folder)
    return C.slice_table(
        slices.join(audits.select(*KEYS), KEYS), KEYS, ["attribute_ord", "group_value"]
    )


_VERDICT = "CASE overall_severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICTS.items()) + " END"


@query(
    f"""WITH {JUDGED}, b AS (SELECT model_id, month,
  string_agg('* ' || name, chr(10) ORDER BY metric_ord) FILTER (breached) AS names FROM merged GROUP BY 1, 2)
SELECT model_id, month, n_breached, {_VERDICT} AS verdict,
  'Fairness of model ' || model_id || ', version ' || model_version || chr(10) || 'Audit ' || audit_id || ' over ' ||
  format('{{:,}}', sample_size) || ' predictions' || chr(10) || chr(10) || 'Verdict: ' || {_VERDICT} || ' (' ||
  overall_severity || ')' || chr(10) || chr(10) || 'Metrics outside their limits: ' || n_breached || chr(10) ||
  coalesce(names || chr(10), '') AS narrative
FROM a JOIN b USING (model_id, month)"""
)
def report_narrative(spark, folder):
    audits, metrics, _ = _tables(spark, folder)
    return C.narrative(audits, metrics, KEYS)


def _plain(x):
    """A number with up to six decimals as SQL text."""
    text = f"regexp_replace(CAST(CAST(round({x}, 6) AS DECIMAL(30, 6)) AS VARCHAR), '0+$', '')"
    return f"({text} || CASE WHEN ends_with({text}, '.') THEN '0' ELSE '' END)"


_NL = "chr(10)"


@query(
    f"""WITH {JUDGED},
l AS (SELECT model_id, month, count(*) AS nm, count(*) FILTER (breached) AS nb,
  string_agg('* ' || name || ' = ' || format('{{:.4f}}', value) || ', limit ' || {_plain('threshold')} ||
    ', ' || severity || ', p = ' || format('{{:.4f}}', p_value), {_NL} ORDER BY metric_ord) FILTER (breached) AS bt,
  string_agg(name, ', ' ORDER BY metric_ord) FILTER (NOT breached) AS pt FROM merged GROUP BY 1, 2),
sl AS (SELECT model_id, month, string_agg('* ' || attribute || ' ' || group_value || ' (' || n || ' rows): selected ' ||
    format('{{:.3f}}', pred_pos / n) || ', true positives ' || {_plain('tp / greatest(tp + fn, 1)')} || ', false positives ' ||
    {_plain('fp / greatest(fp + tn, 1)')}, {_NL} ORDER BY attribute_ord, group_value) AS st
  FROM sq GROUP BY 1, 2)
SELECT model_id, month, 'model: ' || model_id || {_NL} || 'version: ' || model_version || {_NL} || 'audit: ' || audit_id || {_NL} ||
  'from: ' || month || '-01T00:00:00' || {_NL} || 'until: ' ||
  strftime(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 3 MONTH, '%Y-%m-%dT00:00:00') || {_NL} || 'predictions: ' ||
  format('{{:,}}', sample_size) || {_NL} || 'severity: ' || overall_severity || {_NL} || {_NL} ||
  'outside their limits, ' || nb || ' of ' || nm || ' metrics' || {_NL} || coalesce(bt, '(none)') || {_NL} || {_NL} ||
  'within their limits' || {_NL} || coalesce(pt, '(none)') || {_NL} || {_NL} ||
  'groups' || {_NL} || st || {_NL} || {_NL} ||
  'features by weight' || {_NL} || '(unknown)' || {_NL} AS prompt
FROM a JOIN l USING (model_id, month) JOIN sl USING (model_id, month)"""
)
def audit_prompt(spark, folder):
    audits, metrics, slices = _tables(spark, folder)
    return C.prompt_text(audits, metrics, slices, KEYS)


_TOP = f"""{JUDGED}, tv AS (SELECT model_id, month, arg_min(name, metric_ord) FILTER (breached) AS top_name,
    arg_min(value, metric_ord) FILTER (breached) AS top_value, arg_min(threshold, metric_ord) FILTER (breached) AS top_limit
  FROM merged GROUP BY 1, 2)"""


def _alerts(spark, folder):
    audits, metrics, _ = _tables(spark, folder)
    return audits.join(V.top_violation(metrics, KEYS), KEYS)


@query(
    f"""WITH {_TOP}
SELECT model_id, audit_id,
  CASE overall_severity WHEN 'CRITICAL' THEN '🚨' ELSE '⚠️' END || ' ' || model_id || ': audit with severity ' || overall_severity AS headline,
  CASE overall_severity WHEN 'CRITICAL' THEN '#FF0000' ELSE '#FF8C00' END AS color,
  '*Worst metric: ' || {_TITLE.format(c='top_name')} || '*' || chr(10) || '`' ||
    format('{{:.3f}}', top_value) || '`, limit `' || format('{{:.3f}}', top_limit) || '`' AS violation,
  CASE overall_severity WHEN 'CRITICAL' THEN 'danger' ELSE 'primary' END AS style
FROM a JOIN tv USING (model_id, month) WHERE overall_severity IN ('CRITICAL', 'HIGH')"""
)
def alert_payload(spark, folder):
    payload = C.alert_payload(_alerts(spark, folder), "https://dashboard.example")

    def part(path):
        return F.get_json_object("payload", path)

    return payload.select(
        "model_id",
        "audit_id",
        part("$.text").alias("headline"),
        part("$.attachments[0].color").alias("color"),
        part("$.attachments[0].blocks[2].text.text").alias("violation"),
        part("$.attachments[0].blocks[3].elements[0].style").alias("style"),
    )


@query(
    f"""WITH {_TOP} SELECT model_id, overall_severity AS severity, coalesce(top_name, 'none') AS top_metric_name,
  CASE overall_severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS gauge,
  {_DAY} AS day FROM a JOIN tv USING (model_id, month)"""
)
def severity_gauge(spark, folder):
    points = sinks.gauge_points(_alerts(spark, folder))
    return points.withColumn("day", _day("end_time")).drop("end_time")


@query(
    f"""WITH {JUDGED} SELECT model_id, audit_id, {_DAY} AS day, overall_severity, sample_size,
  CASE overall_severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS severity_level
FROM a QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY audit_timestamp DESC) = 1"""
)
def scorecard(spark, folder):
    return views.scorecard(_audit_table(spark, folder)).select(
        "model_id", "audit_id", _day().alias("day"), "overall_severity", "sample_size", "severity_level"
    )


@query(
    f"""WITH {JUDGED} SELECT audit_id, model_id, {_DAY} AS day, overall_severity,
  CASE overall_severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS severity_level
FROM a"""
)
def staged_audits(spark, folder):
    return views.staged_audits(_audit_table(spark, folder)).select(
        "audit_id", "model_id", F.col("day").cast("string").alias("day"), "overall_severity", "severity_level"
    )


@query(
    f"""WITH {JUDGED} SELECT model_id, audit_id, {_DAY} AS day, round(value, 6) AS metric_value, 0.8 AS reference
FROM a JOIN merged USING (model_id, month, audit_timestamp) WHERE name = 'disparate_impact_ratio'"""
)
def metric_trend(spark, folder):
    out = views.metric_trend(_audit_table(spark, folder), "disparate_impact_ratio", 0.80)
    return out.select("model_id", "audit_id", _day().alias("day"), "metric_value", "reference")


@query(
    f"""WITH {JUDGED} SELECT model_id, {_DAY} AS day, name, round(avg(round(value, 6)), 6) AS mean_value, round(max(value), 6) AS max_value,
  count(*) FILTER (breached) AS breaches, count(*) AS audits FROM merged GROUP BY 1, 2, 3"""
)
def fairness_dashboard(spark, folder):
    return views.fairness_dashboard(_audit_table(spark, folder)).select(
        "model_id",
        F.col("day").cast("string").alias("day"),
        "name",
        F.round("mean_value", 6).alias("mean_value"),
        F.round("max_value", 6).alias("max_value"),
        "breaches",
        "audits",
    )


@query(
    f"""WITH {JUDGED} SELECT model_id, month, count(*) AS audits, CAST(sum(sample_size) AS BIGINT) AS predictions,
  arg_min(overall_severity, {_RANK}) AS worst_severity,
  count(*) FILTER (overall_severity = 'CRITICAL') AS n_critical, count(*) FILTER (overall_severity = 'HIGH') AS n_high,
  count(*) FILTER (overall_severity = 'MEDIUM') AS n_medium, count(*) FILTER (overall_severity = 'LOW') AS n_low,
  count(*) FILTER (overall_severity = 'PASS') AS n_pass FROM a GROUP BY model_id, month"""
)
def compliance_summary(spark, folder):
    return views.compliance_summary(_audit_table(spark, folder))


@query(
    f"""WITH {JUDGED}, b AS (SELECT model_id, month, string_agg('"' || name || '"', ',' ORDER BY metric_ord) FILTER (breached) AS names
  FROM merged GROUP BY 1, 2),
pl AS (SELECT model_id, '{{"audit_id":"' || audit_id || '","model_id":"' || model_id || '","model_version":"' || model_version ||
  '","audit_timestamp":"' || strftime(audit_timestamp, '%Y-%m-%dT%H:%M:%S') || '","sample_size":' || sample_size ||
  ',"overall_severity":"' || overall_severity || '","breached_metrics":[' || coalesce(names, '') ||
  '],"triggered_mitigation":false,"mitigation_id":null}}' AS payload FROM a JOIN b USING (model_id, month))
SELECT substr(sha256(concat_ws('|', 'AUDIT_COMPLETED', model_id, 'default', payload, '1999-01-01 00:00:00')), 1, 32) AS event_key,
  'AUDIT_COMPLETED' AS event_type, model_id, 'default' AS tenant_id, payload, 'auditor' AS actor FROM pl"""
)
def ledger_events(spark, folder):
    audits = _tables(spark, folder)[0]
    at = F.lit("1999-01-01").cast("timestamp")
    rows = sinks.ledger_rows(sinks.audit_completed(audits), at)
    return rows.select(
        F.col("EventId").alias("event_key"),
        F.col("EventType").alias("event_type"),
        F.col("ModelId").alias("model_id"),
        F.col("TenantId").alias("tenant_id"),
        F.col("Payload").alias("payload"),
        F.col("ActorServiceId").alias("actor"),
    )


@query(
    f"""WITH {JUDGED} SELECT audit_id, strftime(audit_timestamp, '%Y-%m-%dT%H:%M:%S') AS at FROM a WHERE model_id = 'model-f'"""
)
def ledger_lookup(spark, folder):
    audits = _tables(spark, folder)[0]
    ledger = sinks.ledger_rows(sinks.audit_completed(audits))
    out = sinks.ledger_lookup(ledger, model_id="model-f", tenant_id="default")
    return out.select(
        F.get_json_object("Payload", "$.audit_id").alias("audit_id"),
        F.get_json_object("Payload", "$.audit_timestamp").alias("at"),
    )


@query(
    f"""WITH {JUDGED} SELECT model_id, month, attribute, {_TITLE.format(c='name')} AS feature, round(value, 4) AS importance, metric_ord AS rank
FROM every WHERE breached"""
)
def proxy_importance(spark, folder):
    """Per protected attribute."""
    return C.proxy_importance(_audits(spark, folder)[1], [*KEYS, "attribute"])


@query(
    f"""WITH {JUDGED}, t AS (SELECT model_id, month, {_TITLE.format(c='name')} AS feature, name, metric_ord, breached FROM merged),
k AS (SELECT *, row_number() OVER (PARTITION BY model_id, month ORDER BY metric_ord) AS r FROM t WHERE breached)
SELECT a.model_id, a.month, coalesce(string_agg(feature, ',' ORDER BY r) FILTER (r <= 5), '') AS top_features,
  coalesce(string_agg(name, ',' ORDER BY r), '') AS breached_metrics, CAST(max(g.groups) AS INTEGER) AS n_groups
FROM a JOIN (SELECT model_id, month, count(*) AS groups FROM sq GROUP BY 1, 2) g USING (model_id, month)
LEFT JOIN k USING (model_id, month) GROUP BY 1, 2"""
)
def bias_drivers(spark, folder):
    audits, metrics, slices = _tables(spark, folder)
    out = C.bias_drivers(
        C.proxy_importance(metrics, KEYS), metrics, slices.join(audits.select(*KEYS), KEYS), KEYS
    )

    def names(c, field):
        return F.coalesce(F.array_join(F.transform(c, lambda x: x[field]), ","), F.lit(""))

    return out.select(
        *KEYS,
        names("top_features", "feature").alias("top_features"),
        names("breached_metrics", "name").alias("breached_metrics"),
        F.size("group_performance_gaps").alias("n_groups"),
    )


@query(
    f"""WITH {P} SELECT model_id, sex,
  round(avg(y_pred) FILTER (segment = 'AUTOMOBILE'), 6) AS automobile, round(avg(y_pred) FILTER (segment = 'BUILDING'), 6) AS building,
  round(avg(y_pred) FILTER (segment = 'FURNITURE'), 6) AS furniture, round(avg(y_pred) FILTER (segment = 'HOUSEHOLD'), 6) AS household,
  round(avg(y_pred) FILTER (segment = 'MACHINERY'), 6) AS machinery FROM p GROUP BY 1, 2"""
)
def intersectional_heatmap(spark, folder):
    from evenhand.operators.slices import heatmap

    joint = cube.joint_cube(predictions(spark, folder), ["model_id"], ["sex", "segment"], bins=False)
    cells = joint.groupBy("model_id", "sex", "segment").agg(*cube.confusion_counts())
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    grid = heatmap(cells, ["model_id"], "sex", "segment", names)
    return grid.select("model_id", "sex", *[F.round(n, 6).alias(n.lower()) for n in names])


@query(
    """WITH d AS (SELECT lang, quality AS y_true, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS y_pred
  FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang AS group_value, count(*) AS n, avg(y_pred) AS rate, avg(y_true) AS base FROM d GROUP BY 1)
SELECT group_value, n, round(rate, 6) AS positive_rate, round(base, 6) AS base_rate,
  round((SELECT max(rate) - min(rate) FROM g), 6) AS parity_gap FROM g"""
)
def group_in_documents(spark, folder):
    from evenhand.operators.metrics import group_metrics

    rows = load(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(
        load(spark, folder, "labels"), "doc_id"
    ).select(
        F.lit("documents").alias("model_id"),
        "lang",
        F.col("quality").alias("y_true"),
        (F.col("n_chars") > 600).cast("int").alias("y_pred"),
    )
    groups = cube.confusion_cube(rows, ["model_id"], ["lang"])
    sided = cube.with_sides(groups, cube.audit_frame(groups, ["model_id"]), ["model_id"])
    gap = group_metrics(sided, ["model_id"], ["demographic_parity_difference"])
    return demographic_slices(groups, ["model_id"]).join(gap, "model_id").select(
        "group_value",
        F.col("count").alias("n"),
        F.round("positive_rate", 6).alias("positive_rate"),
        F.round("base_rate", 6).alias("base_rate"),
        F.round("demographic_parity_difference", 6).alias("parity_gap"),
    )


@query(
    "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_totalprice >= 100000 GROUP BY 1"
)
def bound_sql(spark, folder):
    load(spark, folder, "orders").createOrReplaceTempView("bound_sql_orders")
    return run_sql(
        spark,
        "SELECT o_orderpriority, count(*) AS orders FROM bound_sql_orders"
        " WHERE o_totalprice >= :least GROUP BY o_orderpriority",
        least=100000,
    )
