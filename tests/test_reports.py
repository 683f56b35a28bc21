import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from evenhand import schemas
from evenhand.operators import report as C, slices as S, cube
from evenhand.plans import audit as A, views
from evenhand.queries.views import quarter_start
from evenhand.schemas import BIAS_AUDITS
from evenhand.session import scratch_dir
from evenhand.sources import sinks
from test_metrics import frame_of, two_groups

ORDER = list(schemas.SEVERITIES)


def audit(i, severity, metrics, slices, model="m", version=None):
    return (
        f"a{i}", model, version or f"v{i}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), None, None,
        100 + i, severity, json.dumps(metrics), json.dumps(slices), ["sex"], False, None, None,
    )


def metric(name, value, breached, severity="MEDIUM", p=0.01):
    return {"name": name, "value": value, "threshold": 0.1, "breached": breached, "severity": severity,
            "confidence_interval": [0, 1], "groups_compared": ["a", "b"], "sample_sizes": [1, 2], "p_value": p}


def plain_rollup(audits):
    worst, metrics, slices, total, ids, version = "PASS", {}, [], 0, [], "unknown"
    for a in audits:
        ids.append(a[0])
        total += a[6]
        version = a[2]
        if ORDER.index(a[7]) < ORDER.index(worst):
            worst = a[7]
        for name, m in json.loads(a[8]).items():
            if name not in metrics or (m["breached"] and not metrics[name]["breached"]):
                metrics[name] = m
        for s in json.loads(a[9]):
            if not any((x["attribute"], x["group_value"]) == (s["attribute"], s["group_value"]) for x in slices):
                slices.append(s)
    return worst, total, ids, version, metrics, slices[:20]


def test_rollup(spark):
    rng = random.Random(4)
    rows = []
    for i in range(130):
        metrics = {n: metric(n, rng.random(), rng.random() < 0.05) for n in rng.sample("abcdefg", 4)}
        groups = rng.sample(range(40), 6)
        slices = [{"attribute": "x", "group_value": f"g{g}", "count": i, "positive_rate": 0.5, "metrics": {}} for g in groups]
        rows.append(audit(i, rng.choice(ORDER[2:]), metrics, slices))
    df = spark.createDataFrame(rows, BIAS_AUDITS).repartition(6)
    header, metrics, slices = C.compliance_rollup(df)
    worst, total, ids, version, want_metrics, want_slices = plain_rollup(rows[::-1][:100])
    h = header.first()
    assert (h["worst_severity"], h["total_sample_size"], h["audit_ids"], h["model_version"]) == (worst, total, ids, version)
    assert {r["name"]: (r["value"], r["breached"]) for r in metrics.collect()} == {
        n: (m["value"], m["breached"]) for n, m in want_metrics.items()
    }
    got = [(r["group_value"], r["count"]) for r in slices.orderBy("slice_no").collect()]
    assert got == [(s["group_value"], s["count"]) for s in want_slices]


def test_range_is_inclusive_and_newest_first(spark):
    df = spark.createDataFrame([audit(i, "PASS", {}, []) for i in range(10)], BIAS_AUDITS)
    got = [r["audit_id"] for r in C.audit_range(df, "m", "2024-01-03", "2024-01-05").collect()]
    assert got == ["a4", "a3", "a2"]
    assert C.audit_range(df, "other", "2024-01-03", "2024-01-05").count() == 0
    assert C.point_lookup(df, audit_id="a3", model_id="m").first()["sample_size"] == 103


@pytest.mark.parametrize("places", [2, 3, 4])
def test_fixed_matches_python(spark, places):
    rng = random.Random(1)
    values = [0.0, 1.0, 0.0625, 0.8875, 0.0125, 0.0075, 1.97495, 0.99996, 2.5, -0.0625, -0.00001, 12.0045]
    values += [k / 400 for k in range(0, 900, 7)] + [rng.random() * 3 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(C.fixed("v", places)).collect()]
    want = [f"{v:.{places}f}" for v in values]
    assert [g for g in got] == [w if float(w) else w.replace("-", "") for w in want]


def test_regulations(spark):
    rows = [("m", "disparate_impact_ratio", True), ("m", "counterfactual_fairness", False)]
    df = spark.createDataFrame(rows, "model_id string, name string, breached boolean")
    got = {r["regulation"]: r["status"] for r in C.regulatory_status(df, ["model_id"]).collect()}
    assert list(got.values()) == ["NON-COMPLIANT", "N/A", "COMPLIANT"]


def run(spark, positive=(350, 125)):
    rows = frame_of(spark, two_groups(positive)).withColumn("model_version", F.lit("v1"))
    return A.run_audit(rows, ["sex", "missing"], "2024-01-01", "2024-01-02", "2024-01-02", resamples=100)


def test_audit_record(spark):
    audits, metrics = run(spark)
    row = audits.first()
    assert row["overall_severity"] == "CRITICAL" and row["sample_size"] == 1000
    names = audits.select(F.map_keys("metrics")).first()[0]
    assert names == list(schemas.METRIC_THRESHOLDS)
    m = row["metrics"]["demographic_parity_difference"]
    assert m["value"] == 0.45 and m["breached"] and m["severity"] == "CRITICAL"
    assert m["confidence_interval"][0] < 0.45 < m["confidence_interval"][1]
    assert m["groups_compared"] == ["Male", "Female"] and m["sample_sizes"] == [500, 500]
    assert [s["group_value"] for s in row["demographic_slices"]] == ["Female", "Male"]
    assert row["demographic_slices"][1]["metrics"]["positive_rate"] == 0.7
    assert not row["triggered_mitigation"] and row["model_version"] == "v1"
    assert run(spark)[0].first()["audit_id"] == row["audit_id"]


def test_small_samples_are_not_audited(spark):
    rows = frame_of(spark, two_groups((350, 125))[:99]).withColumn("model_version", F.lit("v1"))
    audits, metrics = A.run_audit(rows, ["sex"], "2024-01-01", "2024-01-02", intervals=False)
    assert metrics.count() == 0


def test_past_values_drive_the_drift_index(spark):
    rows = frame_of(spark, two_groups((300, 300)))
    past = spark.createDataFrame(
        [("m", dt.datetime(2024, 1, 1 + i), v) for i, v in enumerate([0.1] * 4 + [0.9] * 8)],
        "model_id string, recorded_at timestamp, metric_value double",
    )
    out = A.audit_metrics(rows, ["model_id"], ["sex"], intervals=False, pairs=False, past=past)
    got = out.where("name = 'temporal_drift_index'").first()
    assert got["value"] == pytest.approx(6.0) and got["breached"]


def test_persist_follows_the_action(spark):
    base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    paths = {t: f"{base}/{t}" for t in ("bias_audits", "fairness_timeseries", "ledger")}
    audits, metrics = run(spark)
    A.persist(audits, metrics.withColumn("attribute_ord", F.lit(0)), paths)
    low = audits.withColumn("overall_severity", F.lit("LOW")).withColumn("model_version", F.lit("v2"))
    A.persist(low, metrics, paths)
    table = spark.read.parquet(paths["bias_audits"])
    assert table.count() == 1 and spark.read.parquet(paths["fairness_timeseries"]).count() == 12
    assert views.slice_drill_down(table).count() == 2
    trend = views.metric_trend(table, "disparate_impact_ratio").first()
    assert trend["metric_value"] == pytest.approx(0.357143)
    ledger = spark.read.parquet(paths["ledger"])
    assert sinks.ledger_lookup(ledger, model_id="m").count() == 2
    payload = json.loads(ledger.where("Payload LIKE '%CRITICAL%'").first()["Payload"])
    assert "disparate_impact_ratio" in payload["breached_metrics"] and payload["mitigation_id"] is None
    stored = table.first()
    assert payload["audit_id"] == stored["audit_id"]
    times = spark.read.parquet(paths["fairness_timeseries"]).select("recorded_at").distinct().collect()
    assert [r["recorded_at"] for r in times] == [stored["audit_timestamp"]]


def test_ledger_refuses_the_whole_batch(spark):
    base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    good = ("AUDIT_COMPLETED", "m", "t", "{}")
    columns = "event_type string, model_id string, tenant_id string, payload string"
    bad = spark.createDataFrame([good, ("NONSENSE", "m", "t", "{}")], columns)
    with pytest.raises(Exception, match="NONSENSE"):
        sinks.append_ledger(bad, base)
    ids = sinks.append_ledger(spark.createDataFrame([good], columns), base)
    assert spark.read.parquet(base).count() == ids.count() == 1


def test_mitigation_event(spark):
    audits, _ = run(spark)
    event = sinks.mitigation_triggered(audits, F.lit("mit-1"), F.lit("Reweighing")).first()
    payload = json.loads(event["payload"])
    assert payload["algorithm"] == "Reweighing" and payload["severity"] == "CRITICAL"


def test_alert_payload_is_json(spark):
    rows = [("m", 'a"1', "CRITICAL", "some_metric", 0.45678, 0.1), ("n", "a2", "LOW", "x", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "model_id string, audit_id string, overall_severity string, top_metric_name string, top_metric_value double, top_metric_threshold double")
    out = C.alert_payload(df, "https://dash.example").collect()
    assert len(out) == 1
    body = json.loads(out[0]["payload"])
    blocks = body["attachments"][0]["blocks"]
    assert [b["type"] for b in blocks] == ["header", "section", "section", "actions"]
    assert "Some Metric" in blocks[2]["text"]["text"] and "`0.457`" in blocks[2]["text"]["text"]
    assert blocks[3]["elements"][0]["style"] == "danger"


def test_slices(spark):
    rows = [(t, p, 0.5, g) for g, p, t in [("Male", 1, 1), ("Male", 1, 0), ("Male", 0, 1), ("Male", 0, 0),
            ("Female", 1, 1), ("Female", 0, 1), ("Female", 0, 0), ("Female", 0, 0)]]
    groups = cube.confusion_cube(frame_of(spark, rows), ["model_id"], ["sex"])
    got = {r["group_value"]: r for r in S.demographic_slices(groups, ["model_id"]).collect()}
    assert (got["Male"]["count"], got["Male"]["positive_rate"], got["Female"]["positive_rate"]) == (4, 0.5, 0.25)
    assert got["Female"]["false_positive_rate"] == 0.0 and got["Female"]["true_negative_rate"] == 1.0
    nested = S.nested_slices(S.demographic_slices(groups, ["model_id"]), ["model_id"], {"extra": F.lit(2.0), "count": F.lit(9.0)})
    one = nested.first()["slice"]
    assert one["metrics"]["extra"] == 2.0 and one["metrics"]["count"] == 9.0


def test_prompt_and_drivers(spark):
    audits, metrics = run(spark)
    groups = cube.confusion_cube(frame_of(spark, two_groups((350, 125))), ["model_id"], ["sex"])
    slices = S.demographic_slices(groups, ["model_id"])
    importance = spark.createDataFrame(
        [("m", "Sex", 0.5, 1), ("m", "income", 0.2, 2)], "model_id string, feature string, importance double, rank int"
    )
    out = C.bias_drivers(importance, metrics, slices, ["model_id"]).first()
    assert [f["feature"] for f in out["sensitive_features_in_top5"]] == ["Sex"]
    assert [g["group"] for g in out["group_performance_gaps"]] == ["sex=Female", "sex=Male"]
    text = C.prompt_text(audits, metrics, slices, ["model_id"], importance).first()["prompt"]
    assert "* 1 Sex 0.5000" in text and "predictions: 1,000" in text
    story = C.narrative(audits, metrics, ["model_id"]).first()
    assert "* disparate_impact_ratio" in story["narrative"] and story["verdict"].startswith("NON-COMPLIANT")


def test_absent_attributes_are_named(spark, caplog):
    rows = frame_of(spark, two_groups((350, 125))).withColumn("model_version", F.lit("v1"))
    with caplog.at_level("WARNING", logger="evenhand"):
        assert A.cube.present_attributes(rows, ["sex", "missing"]) == ["sex"]
    assert "missing" in caplog.text


def test_quarters_are_named_without_a_formatter(spark):
    at = F.explode(F.expr("sequence(timestamp'1969-11-30 23:59:59', timestamp'1973-01-02 00:00:00', interval 17 hours)"))
    times = spark.range(1).select(at.alias("ts")).unionByName(spark.sql("SELECT CAST(NULL AS timestamp) AS ts"))
    named = times.select("ts", quarter_start("ts").alias("month"))
    for r in named.collect():
        assert r.month == (r.ts and f"{r.ts.year:04d}-{(r.ts.month - 1) // 3 * 3 + 1:02d}")
    assert "date_format" not in named._jdf.queryExecution().optimizedPlan().toString()
