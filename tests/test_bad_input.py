"""Input that is repeated, unreadable or odd."""

import json

from pyspark.sql import functions as F

from evenhand.operators import cube
from evenhand.operators.enrich import proxy_enrich
from evenhand.operators.individual import individual_fairness
from evenhand.operators.validate import validate
from evenhand.plans import audit as A
from evenhand.streaming.ingest import write_batch

EVENT = {
    "model_id": "m",
    "model_version": "v1",
    "timestamp": "2024-01-01T00:00:00Z",
    "features": {"sex": "Male"},
    "prediction": {"label": "1", "score": 0.7, "threshold": 0.5},
    "session_context": {"tenant_id": "t", "use_case": "hiring"},
}


def message(**changes):
    return json.dumps({**EVENT, **changes})


def test_features_must_be_an_object(spark):
    texts = [message(), message(features="{not json"), message(features="x")]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = {r["raw"]: r["valid"] for r in validate(df).collect()}
    assert [got[t] for t in texts] == [True, False, False]


def test_equal_messages_get_their_own_ids(spark, tmp_path):
    df = spark.createDataFrame([(message(),)] * 3, "raw string").repartition(2)
    paths = {n: str(tmp_path / n) for n in ("predictions", "demographics", "dead_letters")}
    write_batch(df, 7, paths, "k" * 32)
    ids = {r["event_id"] for r in spark.read.parquet(paths["predictions"]).collect()}
    assert len(ids) == 3
    assert ids == {r["event_id"] for r in spark.read.parquet(paths["demographics"]).collect()}


def test_unreadable_labels_are_not_counted(spark):
    rows = [("m", "a", 1, 1, 0.9), ("m", "a", 0, 0, 0.1), ("m", "b", 1, None, 0.9), ("m", "b", None, 1, 0.2), ("m", "b", 1, 1, 0.8)]
    df = spark.createDataFrame(rows, "model_id string, sex string, y_true int, y_pred int, y_score double")
    cells = cube.confusion_cube(df, ["model_id"], ["sex"]).collect()
    assert {r["group_value"]: (r["n"], r["fn"], r["tp"]) for r in cells} == {"a": (2, 0, 1), "b": (1, 0, 1)}
    status = A.label_status(df, ["model_id"], minimum=2).first()
    assert (status["rows"], status["unreadable"], status["status"]) == (5, 2, "UNREADABLE_LABELS")
    few = A.label_status(df.where("y_true = y_pred"), ["model_id"], minimum=100).first()
    assert few["status"] == "INSUFFICIENT_SAMPLE"


def test_nan_score_does_not_count(spark):
    rows = [("m", "a", 1, 0.9), ("m", "b", 1, 0.1), ("m", "b", 1, float("nan"))]
    df = spark.createDataFrame(rows, "model_id string, sex string, y_true int, y_score double")
    got = individual_fairness(df, ["model_id"], ["sex"]).first()["individual_fairness_score"]
    assert abs(got - 0.2) < 1e-9


def test_proxies_of_repeated_rows(spark):
    rows = spark.createDataFrame(
        [("e", "Ann", "Lee", "1"), ("e", "Ann", "Lee", "1"), ("f", "Bob", "Ray", "2")],
        "event_id string, first_name string, surname string, zip_code string",
    )
    names = spark.createDataFrame([("ann", "F", 3.0), ("ann", "F", 3.0), ("ann", "M", 2.0)], "first_name string, code string, weight double")
    surnames = spark.createDataFrame([("LEE", "a", 0.5), ("LEE", "b", 0.5)], "surname string, code string, weight double")
    places = spark.createDataFrame([("1", "a", 0.3), ("1", "b", 0.1), ("1", "b", 0.1)], "zip_code string, code string, weight double")
    brackets = spark.createDataFrame([("1", "low"), ("1", "low")], "zip_code string, income_bracket string")
    out = {r["event_id"]: r for r in proxy_enrich(rows, names, surnames, places, brackets).collect()}
    assert len(out) == 2 and out["e"]["income_bracket"] == "low"
    assert json.loads(out["e"]["gender_distribution"]) == {"F": 0.75, "M": 0.25}
    assert json.loads(out["e"]["race_distribution"]) == {"a": 0.6, "b": 0.4}


def test_lists_are_split_and_large_ones_refused(spark, tmp_path):
    two = f"[{message()}, {message(model_id='a b')}]"
    large = "[" + ", ".join([message()] * 501) + "]"
    df = spark.createDataFrame([(two,), (large,), (message(),)], "raw string")
    paths = {n: str(tmp_path / n) for n in ("predictions", "demographics", "dead_letters")}
    for _ in range(2):  # a replay changes nothing
        write_batch(df, 3, paths, "k" * 32)
    rows = spark.read.parquet(paths["predictions"])
    assert rows.count() == 2 and [str(r["date"]) for r in rows.select("date").distinct().collect()] == ["2024-01-01"]
    letters = spark.read.parquet(paths["dead_letters"]).collect()
    assert sorted(r["error_message"] for r in letters) == [
        "list: more than 500 events",
        "model_id: contains a space",
    ]
    assert {r["error_type"] for r in letters} == {"ValidationError"}
    assert max(len(r["original_message"]) for r in letters) == len(large)


def test_pair_score_of_rare_events(spark):
    """All scores close to zero: cells follow the scores, and the score stays exact."""
    rows = spark.range(3000).select(
        F.lit("m").alias("model_id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("sex"),
        (F.col("id") % 2).cast("int").alias("y_true"),
        ((F.col("id") * 7919 % 3000) / 3e7).alias("y_score"),
    )
    got = individual_fairness(rows, ["model_id"], ["sex"]).first()
    listed = rows.collect()
    gaps = [
        abs(x["y_score"] - y["y_score"])
        for i, x in enumerate(listed)
        for y in listed[:i]
        if x["y_true"] == y["y_true"] and x["sex"] != y["sex"]
    ]
    assert got["pairs"] == len(gaps)
    assert abs((1 - got["individual_fairness_score"]) - sum(gaps) / len(gaps)) < 1e-12
