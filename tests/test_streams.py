import datetime as dt
import json
import random
import types
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenhand.operators import alerts as N
from evenhand.plans import audit as A
from evenhand.session import scratch_dir
from evenhand.sources.commits import CommitLog
from evenhand.streaming import alert_stream, audit_stream, ingest, redelivery
from test_ingest import GOOD, changed

START = dt.datetime(2024, 1, 1)


def folder(spark):
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def test_ingest_splits_and_is_not_doubled(spark):
    base = folder(spark)
    secret = changed("features", {"mail": "bob@x.org", "sex": "M"})
    lines = [json.dumps(GOOD), json.dumps(secret), json.dumps(changed("model_id", "a b")), "{broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{base}/in")
    paths = {t: f"{base}/{t}" for t in ("predictions", "demographics", "dead_letters")}
    source = spark.readStream.text(f"{base}/in").select(F.col("value").alias("raw"))
    for _ in range(2):  # the second run finds nothing new
        ingest.start_ingest(source, paths, f"{base}/state", "k", {"availableNow": True}).awaitTermination()
    rows = spark.read.parquet(paths["predictions"]).collect()
    assert len(rows) == 2 and not any("bob@x.org" in r["features"] for r in rows)
    assert spark.read.parquet(paths["demographics"]).count() == 2
    errors = {r["error_type"] for r in spark.read.parquet(paths["dead_letters"]).collect()}
    assert errors == {"ValidationError", "JSONDecodeError"}
    batch = spark.createDataFrame([(x,) for x in lines], "raw string")
    ingest.write_batch(batch, 0, paths, "k")  # a replay overwrites
    assert spark.read.parquet(paths["predictions"]).count() == 2


def prediction_rows(spark, n=4000):
    return spark.range(n).select(
        "id",
        F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") * 60).alias("ts"),
        F.lit("m").alias("model_id"),
        F.when(F.col("id") % 3 == 0, "Female").otherwise("Male").alias("sex"),
        ((F.col("id") * 37) % 100 / 100).alias("y_score"),
        ((F.col("id") * 37) % 100 >= F.when(F.col("id") % 3 == 0, 80).otherwise(50)).cast("int").alias("y_pred"),
        (F.col("id") % 2).cast("int").alias("y_true"),
    )


def windowed(rows):
    """Rows once for each day-long window that starts every six hours."""
    back = F.explode(F.array(*[F.lit(k) for k in range(4)]))
    start = F.floor(F.unix_seconds("ts") / 21600) * 21600 - F.col("back") * 21600
    dealt = rows.withColumn("back", back).withColumn("window_start", F.timestamp_seconds(start))
    return dealt.withColumn("window_end", F.timestamp_seconds(start + 86400))


def test_closed_windows_equal_the_batch(spark):
    base = folder(spark)
    rows = prediction_rows(spark).withColumn("event_id", F.concat(F.lit("e"), "id")).withColumn(
        "race", F.when(F.col("id") % 7 < 3, "A").otherwise("B")
    ).withColumn("model_version", F.concat(F.lit("v"), F.col("id") % 3)).drop("id")
    # several files, so that panes close in several batches
    for k in range(3):
        part = rows.where(F.floor((F.unix_seconds("ts") - int(START.timestamp())) / 80000) == k)
        part.coalesce(1).write.parquet(f"{base}/in{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in*")
    options = dict(resamples=100, minimum=50)
    run = audit_stream.start_continuous_audit(
        stream, ["sex", "race"], f"{base}/out", f"{base}/state", "1 day", "6 hours", "1 hour",
        trigger={"availableNow": True}, **options,
    )
    run.awaitTermination()
    assert run.exception() is None and audit_stream.late_rows(run) == 0
    log = CommitLog(spark, f"{base}/out")
    assert len(log.folders("panes")) > 1
    end = log.last_note()
    keys = ["model_id", "window_start", "window_end"]
    want_audits, want = A.run_audit(windowed(rows).where(F.col("window_end") <= end), ["sex", "race"], keys=keys, **options)
    columns = ["window_start", "attribute", "name", "severity", "breached", F.round("value", 9), F.round("ci_lower", 9), F.round("ci_upper", 9)]
    a = sorted(map(str, log.read("audit_metrics").select(columns).collect()))
    b = sorted(map(str, want.select(columns).collect()))
    assert a == b and len(a) >= 24 * 5
    head = ["audit_id", "model_version", "sample_size", "overall_severity"]
    stored = log.read("bias_audits").select(head).collect()
    assert set(stored) <= set(want_audits.select(head).collect())
    assert log.read("ledger").count() == want_audits.count()
    # a replayed batch adds nothing
    names = sorted(log.names())
    again = log.read("panes").drop("date").limit(5)
    assert not audit_stream.audit_closed(log, again, 1, ["sex", "race"], "1 day", "6 hours", **options)
    assert sorted(log.names()) == names


def test_a_broken_commit_shows_nothing_and_a_repeated_one_adds_nothing(spark):
    log = CommitLog(spark, folder(spark))
    a = spark.range(10).withColumn("date", F.lit("2024-01-01"))
    b = spark.range(5)
    assert log.read("a") is None and log.names() == set()
    broken = b.select(F.when(F.col("id") > 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        log.commit("one", {"a": a, "b": broken}, {"a": ["date"]})
    assert log.read("a") is None and log.read("b") is None  # a's files are there, but named by nobody
    assert log.commit("one", {"a": a, "b": b}, {"a": ["date"]}, note="1")
    assert not log.commit("one", {"a": a, "b": b})
    assert log.commit("two", {"a": a}, {"a": ["date"]}, note="2")
    assert (log.read("a").count(), log.read("b").count(), log.last_note()) == (20, 5, "2")
    assert log.compact("a", "three", ["date"], where=F.col("id") >= 5)
    assert not log.compact("a", "three")
    assert log.read("a").count() == 10 and len(log.folders("a")) == 1 and log.read("b").count() == 5
    assert log.commit("four", {"a": a.limit(1)}, {"a": ["date"]}) and log.read("a").count() == 11


def points(spark, minutes):
    rows = [("m", START + dt.timedelta(minutes=m, seconds=5), "CRITICAL" if g == 4 else "LOW", g) for m, g in minutes]
    return spark.createDataFrame(rows, "model_id string, end_time timestamp, severity string, gauge int")


HELD = [(m, 4) for m in (0, 1, 2, 10, 11, 12, 13, 14, 15, 30, 31, 32, 33, 35)] + [(20, 1)]


def test_alert_rules(spark):
    df = points(spark, HELD)
    assert N.immediate_alerts(df, ["model_id"]).count() == 14
    runs = N.sustained_alerts(df, ["model_id"]).collect()
    first = int(START.timestamp()) // 60
    assert [(r["first_bucket"], r["last_bucket"], r["buckets"]) for r in runs] == [(first + 10, first + 15, 6)]


def test_alert_streams(spark):
    base = folder(spark)
    df = points(spark, HELD + [(500, 1), (501, 4)])
    df.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    out = alert_stream.sustained_alert_stream(stream)
    run = (
        out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    rows = spark.read.parquet(f"{base}/out").collect()
    first = int(START.timestamp()) // 60
    assert [(r["first_bucket"], r["last_bucket"]) for r in rows] == [(first + 10, first + 14)] or [
        (r["first_bucket"], r["last_bucket"]) for r in rows
    ] == [(first + 10, first + 15)]
    now = alert_stream.immediate_alert_stream(stream, ["model_id"])
    run = (
        now.writeStream.outputMode("append").format("parquet").option("path", f"{base}/now")
        .option("checkpointLocation", f"{base}/state2").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert spark.read.parquet(f"{base}/now").count() == 14


def test_redelivered_events_are_dropped(spark):
    base = folder(spark)
    rows = spark.createDataFrame(
        [("a", START), ("a", START), ("b", START)], "event_id string, timestamp timestamp"
    )
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    run = (
        ingest.drop_duplicates(stream).writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{base}/out").collect()) == ["a", "b"]


def test_rate_limit_counts_a_sliding_minute(spark):
    seconds = [0, 10, 20, 59, 60, 61, 119.5, 180, 180, 181]
    rows = [("k", START + dt.timedelta(seconds=s)) for s in seconds]
    df = spark.createDataFrame(rows, "user string, ts timestamp")
    got = N.rate_limit(df, "user", "ts", limit=3).orderBy("at_micros").collect()
    base = int(START.timestamp() * 1_000_000)
    for r in got:
        at = (r["at_micros"] - base) / 1e6
        assert r["in_window"] == sum(1 for s in seconds if at - 60 < s <= at)
        assert r["limited"] == (r["in_window"] > 3)


def test_messages_are_taken_once_and_given_up_after_five(spark):
    base = folder(spark)
    good, broken = json.dumps(GOOD), "{broken"
    times = [START + dt.timedelta(minutes=m) for m in range(8)]
    rows = [("a", good, times[0]), ("a", good, times[1])]  # delivered twice
    rows += [("b", broken, t) for t in times[:7]]  # never parses, and comes after it was given up
    rows += [("c", broken, times[0]), ("c", broken, times[2]), ("c", json.dumps([GOOD, GOOD]), times[4])]
    sent = spark.createDataFrame(rows, "message_id string, raw string, at timestamp").repartition(2)
    sent.write.parquet(f"{base}/in")
    paths = {t: f"{base}/{t}" for t in ("predictions", "demographics", "dead_letters", "retries")}
    for _ in range(2):
        stream = spark.readStream.schema(sent.schema).parquet(f"{base}/in")
        run = ingest.start_ingest(stream, paths, f"{base}/state", "k", {"availableNow": True})
        run.awaitTermination()
        assert run.exception() is None
    assert spark.read.parquet(paths["predictions"]).count() == 3
    dead = spark.read.parquet(paths["dead_letters"]).collect()
    assert len(dead) == 1
    retries = spark.read.parquet(paths["retries"]).orderBy("message_id", "attempt").collect()
    assert [(r.message_id, r.attempt) for r in retries] == [("b", k) for k in (1, 2, 3, 4)] + [("c", 1), ("c", 2)]
    assert [r.due_at - times[k] for k, r in enumerate(retries[:4])] == [dt.timedelta(seconds=10 * 2**k) for k in range(4)]


def test_settled_messages_are_forgotten(spark):
    base = folder(spark)
    schema = "message_id string, raw string, at timestamp, failed boolean"
    steps = [[("a", "x", START, True)], [("z", "x", START + dt.timedelta(hours=9), False)], [("a", "x", START + dt.timedelta(hours=9), True)]]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/part{k}")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        out = redelivery.settle_deliveries(stream).writeStream.format("parquet").option("path", f"{base}/out")
        out.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out").where("message_id = 'a'").collect()
    assert [r.attempt for r in rows] == [1, 1]
    assert [redelivery.delay(k) for k in (1, 2, 7, 40)] == [10, 20, 600, 600]


class _Kept:
    """A value and timers as a state keeps them."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.exists, self.get = lambda: self.value is not None, lambda: self.value
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_one_call_settles_many_messages():
    rng = random.Random(3)
    kept, now = _Kept(), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    bucket = redelivery.Attempts(5, 7200)
    bucket.init(kept)
    known = {}
    for batch in range(4):
        rows = [(rng.choice([None, *"abcdefgh"]), f"{batch}-{k}", START + dt.timedelta(minutes=60 * batch, seconds=rng.randrange(3000), milliseconds=k), rng.random() < 0.85) for k in range(25)]
        frame = pd.DataFrame(rows, columns=["message_id", "raw", "at", "failed"])
        (out,) = bucket.handleInputRows((0,), iter([frame[:10], frame[10:]]), now)
        want = {}
        for name, raw, at, failed in sorted(rows, key=lambda r: r[2]):
            n, settled = known.get(name, (0, False))
            outcome, due = "duplicate", None
            if not settled:
                n += 1
                outcome = "accepted" if not failed else "dead" if n == 5 else "retry"
                due = at + dt.timedelta(seconds=redelivery.delay(n)) if outcome == "retry" else None
            known[name] = (n, settled or outcome in ("accepted", "dead"))
            want[raw] = (name, outcome, n, due)
        due = [None if pd.isna(x) else x.to_pydatetime() for x in out["due_at"]]
        assert dict(zip(out["raw"], zip(out["message_id"], out["outcome"], out["attempt"], due))) == want
        assert len(kept.timers) == 1
    late = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: max(kept.value[3]) + 1)
    assert list(bucket.handleExpiredTimer((0,), late, None)) == [] and kept.value is None
