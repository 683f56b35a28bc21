"""Continuous audits, commits over several tables and redelivery, as streams run them."""

import uuid

from pyspark.sql import functions as F

from evenhand.queries import query
from evenhand.queries.audits import JUDGED_CTE, OVERALL_SQL
from evenhand.queries.views import ATTRIBUTES, PREDICTIONS_SQL, predictions
from evenhand.session import keyed_state, scratch_dir
from evenhand.sources.commits import CommitLog
from evenhand.sources.tables import load
from evenhand.streaming.audit_stream import start_continuous_audit
from evenhand.streaming.redelivery import settle_deliveries


def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, folder, name):
    """A table as a stream; times without a zone are read as UTC."""
    table = load(spark, folder, name)
    plain = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(plain).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.select(*[F.col(f.name).cast(f.dataType) for f in table.schema])


# Every row once for each window of two years that holds it and is closed: its end lies
# behind the newest pane that the watermark, a day behind the newest row, has passed.
_DAY = "CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 86400) AS BIGINT)"
_WINDOWED = f"""
SELECT b.* EXCLUDE (pane) REPLACE (b.model_id || '~' || CAST(DATE '1970-01-01' + CAST((pane - back) * 365 AS INTEGER) AS VARCHAR) AS model_id)
FROM (SELECT *, {_DAY} // 365 AS pane FROM ({PREDICTIONS_SQL})) b, (SELECT unnest([0, 1]) AS back)
WHERE (pane - back + 2) * 365 <= (SELECT max(({_DAY} // 365 + 1) * 365) FROM ({PREDICTIONS_SQL})
  WHERE ({_DAY} // 365 + 1) * 365 <= (SELECT max({_DAY}) - 1 FROM ({PREDICTIONS_SQL})))
"""


@query(
    f"""WITH {JUDGED_CTE.replace(PREDICTIONS_SQL, _WINDOWED)},
every AS (SELECT string_split(model_id, '~')[1] AS model_id, string_split(model_id, '~')[2] AS window_start, judged.* EXCLUDE (model_id)
  FROM judged JOIN f USING (model_id, attribute, attribute_ord) WHERE sample_size >= 100),
merged AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY model_id, window_start, name ORDER BY attribute_ord DESC) = 1),
o AS ({OVERALL_SQL.format(keys='model_id, window_start', rel='merged')})
SELECT model_id, window_start, attribute, name, round(value, 6) AS value, threshold, breached, severity, true AS ordered,
  CASE WHEN overall_severity <> 'LOW' THEN 1 END AS records, CASE WHEN overall_severity <> 'LOW' THEN 12 END AS history, 1 AS ledger
FROM every JOIN o USING (model_id, window_start)"""
)
def continuous_audit(spark, folder):
    """A stream of line items, audited window by window as the windows close: all metrics of
    both attributes with their intervals, and what each audit left in its tables."""
    base = _folder(spark, "continuous")
    events = predictions(spark, folder, _stream(spark, folder, "lineitem"))
    run = start_continuous_audit(
        events, ATTRIBUTES, f"{base}/tables", f"{base}/state", "730 days", "365 days", "1 day", {"availableNow": True}
    )
    run.awaitTermination()
    log = CommitLog(spark, f"{base}/tables")
    metrics, audits, series, ledger = (
        log.read(t) for t in ("audit_metrics", "bias_audits", "fairness_timeseries", "ledger")
    )
    count = F.count("*").cast("int")
    records = audits.groupBy("audit_id").agg(count.alias("records"))
    history = series.groupBy("model_id", F.col("recorded_at").alias("audit_timestamp")).agg(count.alias("history"))
    events = ledger.groupBy(F.get_json_object("Payload", "$.audit_id").alias("audit_id")).agg(count.alias("ledger"))
    return (
        metrics.join(records, "audit_id", "left")
        .join(history, ["model_id", "audit_timestamp"], "left")
        .join(events, "audit_id", "left")
        .select(
            "model_id",
            F.date_format("window_start", "yyyy-MM-dd").alias("window_start"),
            "attribute",
            "name",
            F.round("value", 6).alias("value"),
            "threshold",
            "breached",
            "severity",
            (F.col("ci_lower") <= F.col("ci_upper")).alias("ordered"),
            "records",
            "history",
            "ledger",
        )
    )


@query(
    """WITH o AS (SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(38, 2)) AS total FROM orders GROUP BY 1),
s(step, times) AS (VALUES ('2 committed', 1), ('3 repeated', 1), ('4 second', 2), ('5 compacted', 2))
SELECT '1 broken' AS step, NULL AS status, CAST(0 AS BIGINT) AS n, NULL AS total, CAST(0 AS BIGINT) AS lines
UNION ALL SELECT step, status, times * n, round(CAST(times * total AS DOUBLE), 2), times * (SELECT count(*) FROM lineitem) FROM o, s"""
)
def commit_log(spark, folder):
    """Two tables written together: what readers see after a commit that broke between them,
    a whole one, its repetition, a second one and a compaction."""
    log = CommitLog(spark, _folder(spark, "commits"))
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"))
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    newest = lines.agg(F.max("l_orderkey")).first()[0]
    broken = F.when(F.col("l_orderkey") == newest, F.raise_error(F.lit("broken on purpose"))).otherwise(F.col("l_orderkey"))
    layout = {"orders": ["status"]}

    def seen(step):
        rows = log.read("orders")
        if rows is None:
            n = 0 if log.read("lines") is None else None
            return spark.createDataFrame([(step, None, n, None, n)], "step string, status string, n long, total double, lines long")
        total = F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double"), 2)
        return rows.groupBy("status").agg(F.count("*").alias("n"), total.alias("total")).select(
            F.lit(step).alias("step"), "status", "n", "total", F.lit(log.read("lines").count()).alias("lines")
        )

    try:
        log.commit("first", {"orders": orders, "lines": lines.withColumn("l_orderkey", broken)}, layout)
    except Exception as e:
        if "broken on purpose" not in str(e):
            raise
    out = [seen("1 broken")]
    for step, name in (("2 committed", "first"), ("3 repeated", "first"), ("4 second", "second")):
        log.commit(name, {"orders": orders, "lines": lines}, layout)
        out.append(seen(step))
    log.compact("orders", "compaction", ["status"])
    out.append(seen("5 compacted"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


# Every event fails up to six times before it succeeds, and some come once more.
_DELIVERIES = """d AS (SELECT event_id, ts, event_id % 7 AS fails, unnest(range(0, event_id % 7 + 1 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)) AS k FROM events)"""


@query(
    f"""WITH {_DELIVERIES},
o AS (SELECT *, CASE WHEN k < fails AND k < 4 THEN 'retry' WHEN k = 4 AND fails >= 5 THEN 'dead'
    WHEN k = fails AND fails < 5 THEN 'accepted' ELSE 'duplicate' END AS outcome FROM d)
SELECT CAST(event_id AS VARCHAR) AS message_id, CAST(k AS BIGINT) AS delivery, outcome, CAST(least(k + 1, fails + 1, 5) AS INTEGER) AS attempt,
  CASE WHEN outcome = 'retry' THEN least(10 * CAST(2 ** k AS BIGINT), 600) END AS delay_seconds FROM o"""
)
def redelivery_stream(spark, folder):
    """Deliveries of every event through the state of attempts: retried with growing delay,
    dead after five, taken once."""
    base = _folder(spark, "redelivery")
    events = load(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("message_id"), "ts", (F.col("event_id") % 7).alias("fails")
    )
    again = F.when(F.col("message_id").cast("long") % 3 == 0, 1).otherwise(0)
    sent = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("fails") + again))).select(
        "message_id",
        F.col("k").cast("string").alias("raw"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("k").cast("int"))).alias("at"),
        (F.col("k") < F.col("fails")).alias("failed"),
    )
    sent.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(sent.schema).parquet(f"{base}/in")
    writer = settle_deliveries(stream).writeStream.format("parquet").option("path", f"{base}/out")
    with keyed_state(spark):
        run = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    delay = F.unix_seconds("due_at") - F.unix_seconds("at")
    return spark.read.parquet(f"{base}/out").select(
        "message_id", F.col("raw").cast("long").alias("delivery"), "outcome", "attempt", delay.alias("delay_seconds")
    )
