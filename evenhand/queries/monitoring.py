"""Gauges, alerts, counters, request rates and the sliding and streaming audits."""

import uuid

from pyspark.sql import functions as F

from evenhand.operators import alerts as N
from evenhand.operators.cube import group_cube
from evenhand.queries import query
from evenhand.queries.ingest import _JUDGED, messages
from evenhand.schemas import SEVERITY_GAUGE
from evenhand.session import scratch_dir
from evenhand.sources.tables import load
from evenhand.streaming.audit_stream import WINDOW_KEYS, judge_windows, sliding_cube
from evenhand.streaming.ingest import start_ingest

# The events table as severity gauges of one model per event type.
_POINTS = """pts AS (SELECT event_type AS model_id, ts AS end_time, CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER) % 5 AS gauge FROM events)"""


def _k():
    return F.regexp_replace("props", "[^0-9]", "").cast("int")


def gauge_events(spark, folder):
    names = F.create_map(*[F.lit(x) for s, g in SEVERITY_GAUGE.items() for x in (g, s)])
    gauge = _k() % 5
    return load(spark, folder, "events").select(
        F.col("event_type").alias("model_id"),
        F.col("ts").alias("end_time"),
        gauge.alias("gauge"),
        names[gauge].alias("severity"),
    )


@query(
    f"""WITH {_POINTS} SELECT model_id, CAST(floor(epoch(date_trunc('second', end_time)) / 60) AS BIGINT) AS bucket, max(gauge) AS gauge FROM pts GROUP BY 1, 2"""
)
def gauge_buckets(spark, folder):
    return N.gauge_buckets(gauge_events(spark, folder), ["model_id"])


@query(
    f"""WITH {_POINTS} SELECT model_id, CAST(floor(epoch(date_trunc('second', end_time)) / 60) AS BIGINT) AS bucket, max(gauge) AS gauge FROM pts
WHERE gauge = 4 GROUP BY 1, 2"""
)
def immediate_alerts(spark, folder):
    return N.immediate_alerts(gauge_events(spark, folder), ["model_id"])


@query(
    f"""WITH {_POINTS}, b AS (SELECT model_id, CAST(floor(epoch(date_trunc('second', end_time)) / 3600) AS BIGINT) AS bucket, max(gauge) AS gauge FROM pts GROUP BY 1, 2),
f AS (SELECT *, bucket - row_number() OVER (PARTITION BY model_id ORDER BY bucket) AS island FROM b WHERE gauge > 3)
SELECT model_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS buckets FROM f GROUP BY model_id, island HAVING count(*) * 3600 >= 10800"""
)
def sustained_alerts(spark, folder):
    return N.sustained_alerts(gauge_events(spark, folder), ["model_id"], seconds=3600, hold=10800)


@query(
    f"""WITH d AS (SELECT event_type AS model_id, CAST(ts AS DATE) AS day, count(*) AS added FROM events GROUP BY 1, 2)
SELECT model_id, strftime(day, '%Y-%m-%d') AS day, added, CAST(sum(added) OVER (PARTITION BY model_id ORDER BY day) AS BIGINT) AS total FROM d"""
)
def running_counters(spark, folder):
    rows = load(spark, folder, "events").withColumnRenamed("event_type", "model_id")
    out = N.running_counters(rows, ["model_id"], "ts")
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    """WITH c AS (SELECT user_id, epoch_us(ts) AS at_micros, count(*) AS requests FROM events GROUP BY 1, 2)
SELECT user_id, at_micros, requests, CAST(sum(requests) OVER w AS BIGINT) AS in_window, sum(requests) OVER w > 2 AS limited
FROM c WINDOW w AS (PARTITION BY user_id ORDER BY at_micros RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)"""
)
def rate_limit_log(spark, folder):
    return N.rate_limit(load(spark, folder, "events"), "user_id", "ts", limit=2, seconds=21600)


# Audits over events: one day every six hours, groups from the props.
_EVENT_ROWS = """
ev AS (SELECT ts, event_type AS model_id, 'g' || CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER) % 3 AS grp,
  least(value / 500, 1) AS y_score, CASE WHEN value >= 40 THEN 1 ELSE 0 END AS y_pred, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS y_true FROM events),
wn AS (SELECT ev.*, unnest(generate_series(0, 3)) AS k,
  to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP - to_hours(CAST(6 * k AS BIGINT)) AS ws FROM ev)"""


def audit_events(df):
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model_id"),
        F.concat(F.lit("g"), (_k() % 3).cast("string")).alias("grp"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("y_score"),
        (F.col("value") >= 40).cast("int").alias("y_pred"),
        (F.col("user_id") % 2 == 0).cast("int").alias("y_true"),
    )


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


_WINDOW_CELLS = "strftime(ws, '%Y-%m-%d %H:%M') AS window_start, grp AS group_value, count(*) AS n, CAST(sum(y_pred) AS BIGINT) AS pred_pos, CAST(sum(y_pred * y_true) AS BIGINT) AS tp"


def _group_rows(joint):
    groups = group_cube(joint, list(WINDOW_KEYS), ["grp"])
    return groups.select(
        "model_id", _time("window_start").alias("window_start"), "group_value", "n", "pred_pos", "tp"
    )


@query(f"WITH {_EVENT_ROWS} SELECT model_id, {_WINDOW_CELLS} FROM wn GROUP BY model_id, ws, grp")
def sliding_audit_cube(spark, folder):
    joint = sliding_cube(audit_events(load(spark, folder, "events")), ["grp"], "1 day", "6 hours")
    return _group_rows(joint)


@query(
    f"""WITH {_EVENT_ROWS}, g AS (SELECT model_id, ws, grp, avg(y_pred) AS r, count(*) AS n FROM wn GROUP BY 1, 2, 3)
SELECT model_id, strftime(ws, '%Y-%m-%d %H:%M') AS window_start, round(max(r) - min(r), 6) AS value, max(r) - min(r) > 0.10 AS breached
FROM g GROUP BY model_id, ws HAVING sum(n) >= 30"""
)
def sliding_audit(spark, folder):
    joint = sliding_cube(audit_events(load(spark, folder, "events")), ["grp"], "1 day", "6 hours")
    judged = judge_windows(joint, ["grp"], minimum=30)
    return judged.where("name = 'demographic_parity_difference'").select(
        "model_id",
        _time("window_start").alias("window_start"),
        F.round("value", 6).alias("value"),
        "breached",
    )


def event_stream(spark, folder):
    """The events file as a stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )


@query(
    f"""WITH {_EVENT_ROWS} SELECT model_id, {_WINDOW_CELLS} FROM wn
WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY model_id, ws, grp"""
)
def sliding_audit_stream(spark, folder):
    """The cube of closed windows as a stream writes it."""
    load(spark, folder, "events")
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    joint = sliding_cube(audit_events(event_stream(spark, folder)), ["grp"], "1 day", "6 hours", "1 hour")
    run = (
        joint.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/cube")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return _group_rows(spark.read.parquet(f"{base}/cube"))


@query(
    f"""WITH {_JUDGED}
SELECT 'predictions' AS table_name, count(*) AS n FROM judged WHERE message = ''
UNION ALL SELECT 'demographics', count(*) FROM judged WHERE message = ''
UNION ALL SELECT 'dead_letters', count(*) FROM judged WHERE message <> ''"""
)
def ingest_stream(spark, folder):
    """Messages through the streaming ingest into its three tables, counted."""
    base = f"{scratch_dir(spark)}/ingest-{uuid.uuid4().hex}"
    messages(spark, folder).select("raw").write.text(f"{base}/in")
    source = spark.readStream.text(f"{base}/in").select(F.col("value").alias("raw"))
    paths = {t: f"{base}/{t}" for t in ("predictions", "demographics", "dead_letters")}
    start_ingest(source, paths, f"{base}/state", "bench-key", {"availableNow": True}).awaitTermination()
    counted = [
        spark.read.parquet(path).select(F.lit(t).alias("table_name"))
        for t, path in paths.items()
    ]
    rows = counted[0].unionByName(counted[1]).unionByName(counted[2])
    return rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
