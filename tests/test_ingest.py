import json

import pytest
from pyspark.sql import functions as F

from evenhand.operators.cube import latest_demographics
from evenhand.operators.enrich import age_bin, enrich
from evenhand.operators.validate import dead_letters, flatten_valid, validate
from evenhand.plans.audit import label_columns, scan_window, sensitive_columns
from evenhand.sources.events import event_json, new_events, split_bodies

GOOD = {
    "event_id": "e1",
    "model_id": "credit-v1",
    "model_version": "1.0",
    "timestamp": "2024-03-01T10:00:00Z",
    "features": {"sex": "Male", "age": 35},
    "prediction": {"label": "1", "score": 0.8, "threshold": 0.5},
    "ground_truth": "1",
    "session_context": {"tenant_id": "t", "use_case": "lending"},
}


def changed(path, value="__drop__"):
    event = json.loads(json.dumps(GOOD))
    at = event
    *parents, last = path.split(".")
    for p in parents:
        at = at[p]
    if value == "__drop__":
        del at[last]
    else:
        at[last] = value
    return event


def judge(spark, *messages):
    raw = [(m if isinstance(m, str) else json.dumps(m),) for m in messages]
    return validate(spark.createDataFrame(raw, "raw string"))


VALID = [
    GOOD,
    changed("event_id"),
    changed("ground_truth"),
    changed("ground_truth", None),
    changed("prediction.score", 0),
    changed("prediction.score", 1.0),
    changed("prediction.score", "0.25"),
    changed("timestamp", 1709287200),
    changed("timestamp", 1709287200000),
    changed("timestamp", "2024-03-01 10:00:00"),
    changed("features", {}),
    {**GOOD, "unknown": [1, 2]},
]
INVALID = [
    (changed("model_id"), "model_id: required"),
    (changed("model_id", None), "model_id: required"),
    (changed("model_id", 5), "model_id: not a string"),
    (changed("model_id", "a b"), "model_id: contains a space"),
    (changed("model_version"), "model_version: required"),
    (changed("timestamp"), "timestamp: required"),
    (changed("timestamp", "yesterday"), "timestamp: not a time"),
    (changed("features"), "features: required"),
    (changed("features", [1]), "features: not an object"),
    (changed("features", "text"), "features: not an object"),
    (changed("prediction.label", 1), "prediction.label: not a string"),
    (changed("prediction.score", -0.1), "prediction.score: outside 0..1"),
    (changed("prediction.score", 1.1), "prediction.score: outside 0..1"),
    (changed("prediction.threshold", 1.1), "prediction.threshold: outside 0..1"),
    (changed("prediction.threshold", "x"), "prediction.threshold: not a number"),
    (changed("session_context.tenant_id"), "session_context.tenant_id: required"),
    (changed("session_context.use_case", "weather"), "session_context.use_case: unknown"),
    (changed("ground_truth", 1), "ground_truth: not a string"),
    (changed("event_id", None), "event_id: not a string"),
    ('{"model_id": "x", ', "json: cannot be parsed"),
    ("[1, 2", "json: cannot be parsed"),
    ("", "json: cannot be parsed"),
]


def test_valid_events(spark):
    out = judge(spark, *VALID)
    assert out.where("NOT valid").collect() == []
    rows = flatten_valid(out).collect()
    assert len(rows) == len(VALID)
    assert {str(r["timestamp"]) for r in rows} == {"2024-03-01 10:00:00"}
    assert all(r["event_id"] for r in rows) and all(r["demographic_tags"] == [] for r in rows)
    again = [r["event_id"] for r in flatten_valid(judge(spark, *VALID)).collect()]
    assert sorted(again) == sorted(r["event_id"] for r in rows)


@pytest.mark.parametrize("count", [len(INVALID)])
def test_invalid_events(spark, count):
    out = judge(spark, *[m for m, _ in INVALID])
    assert out.where("valid").count() == 0
    got = {r["original_message"]: r for r in dead_letters(out).collect()}
    assert len(got) == count
    for message, error in INVALID:
        raw = message if isinstance(message, str) else json.dumps(message)
        assert got[raw]["error_message"].split("; ") == [error]
        assert got[raw]["error_type"] == ("JSONDecodeError" if "json" in error else "ValidationError")


def test_bodies(spark):
    many = json.dumps([GOOD] * 501)
    bodies = [("one", json.dumps(GOOD)), ("two", json.dumps([GOOD, GOOD])), ("big", many), ("bad", "[{")]
    rows = split_bodies(spark.createDataFrame(bodies, "k string, raw string"))
    got = {r["k"]: (r["c"], r["o"]) for r in rows.groupBy("k").agg(F.count("*").alias("c"), F.max("oversized").alias("o")).collect()}
    assert got == {"one": (1, False), "two": (2, False), "big": (501, True), "bad": (1, False)}
    assert validate(rows.where("k = 'two'")).where("valid").count() == 2


def test_new_events_round_trip(spark):
    rows = spark.createDataFrame(
        [('{"sex":"Male"}', ("1", 0.7, 0.5), "1")],
        "features string, prediction struct<label:string,score:double,threshold:double>, ground_truth string",
    )
    events = new_events(rows, "m", "v1", "t", "hiring")
    out = validate(event_json(events))
    row = flatten_valid(out).first()
    assert row["model_id"] == "m" and row["event_id"] and json.loads(row["features"]) == {"sex": "Male"}


def enriched(spark, features):
    df = spark.createDataFrame([("e", "m", features)], "event_id string, model_id string, features string")
    return enrich(df.withColumn("timestamp", F.current_timestamp())).first()


@pytest.mark.parametrize(
    "features, gender, race, age, zip_code",
    [
        ({"sex": " M ", "age": 35.9, "race": "Black", "zip": " 123 "}, "MALE", "BLACK", "AGE_30_40", "123"),
        ({"gender": "x", "sex": "f"}, "FEMALE", None, None, None),
        ({"Gender": 1, "Age": "18"}, "FEMALE", None, "AGE_18_30", None),
        ({"ethnicity": "hispanic", "race": "White"}, None, "HISPANIC", None, None),
        ({"age": 999}, None, None, None, None),
        ({"age": -1, "AGE": "60"}, None, None, "AGE_60_PLUS", None),
        ({"age": "old"}, None, None, None, None),
        ({}, None, None, None, None),
    ],
)
def test_enrichment(spark, features, gender, race, age, zip_code):
    row = enriched(spark, json.dumps(features))
    assert row["gender_distribution"] == (f'{{"{gender}":1.0}}' if gender else None)
    assert row["race_distribution"] == (f'{{"{race}":1.0}}' if race else None)
    assert (row["age_bin"], row["zip_code"], row["is_proxy"]) == (age, zip_code, False)
    assert row["proxy_quality_score"] == (1.0 if gender or race or age else None)


def test_age_edges(spark):
    df = spark.createDataFrame([(a,) for a in (0, 17, 18, 29, 30, 59, 60, 998, 999, -1)], "a int")
    got = [r[0] for r in df.select(age_bin("a")).collect()]
    assert got == ["AGE_UNDER_18"] * 2 + ["AGE_18_30"] * 2 + ["AGE_30_40", "AGE_50_60"] + ["AGE_60_PLUS"] * 2 + [None] * 2


def test_bad_features_are_no_failure(spark):
    assert enriched(spark, "not json")["proxy_quality_score"] is None
    assert enriched(spark, None)["proxy_quality_score"] is None


def test_scan_is_half_open_and_fans_out(spark):
    rows = flatten_valid(judge(spark, GOOD, changed("event_id", "e2"), changed("ground_truth")))
    side = spark.createDataFrame([("e1", "A", 1), ("e1", "B", 2)], "event_id string, age_bin string, enriched_at int")
    side = side.withColumn("gender_distribution", F.lit(None).cast("string")).withColumn("race_distribution", F.lit(None).cast("string"))
    assert scan_window(rows, start="2024-03-01 10:00:00", end="2024-03-01 10:00:01").count() == 2
    assert scan_window(rows, start="2024-03-01 09:00:00", end="2024-03-01 10:00:00").count() == 0
    assert scan_window(rows, side).count() == 3
    latest = scan_window(rows, latest_demographics(side)).collect()
    assert {(r["event_id"], r["age_bin"]) for r in latest} == {("e1", "B"), ("e2", None)}


def test_labels_and_sensitive_columns(spark):
    rows = spark.createDataFrame(
        [("1", "0", "0.5", '{"sex":"M","race":"White"}'), ("approved", "1", "x", '{"sex":"other"}')],
        "ground_truth string, prediction_label string, prediction_score string, features string",
    )
    got = [tuple(r) for r in label_columns(rows).select("y_true", "y_pred", "y_score", "label_error").collect()]
    assert got == [(1, 0, 0.5, False), (None, 1, None, True)]
    named = label_columns(rows, ["approved"]).select("y_true", "y_pred").collect()
    assert [tuple(r) for r in named] == [(0, 0), (1, 0)]
    assert [r["sex"] for r in sensitive_columns(rows).collect()] == ["Male", "other"]
