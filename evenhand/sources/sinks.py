"""Append-only table sinks. Each append is one atomic Spark write job."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F, types as T

from evenhand.schemas import LEDGER_EVENT_TYPES, MITIGATION_LOG, SEVERITY_GAUGE


def append(df: DataFrame, path: str, partition_by=(), sort_by=()) -> None:
    """Append to a Parquet table; ``sort_by`` orders rows inside files so that
    row-group statistics can skip."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_predictions(df: DataFrame, path: str) -> None:
    append(
        df.withColumn("date", F.to_date("timestamp")),
        path,
        ["date"],
        ["model_id", "prediction_label"],
    )


def append_demographics(df: DataFrame, path: str) -> None:
    append(df.withColumn("date", F.to_date("timestamp")), path, ["date"], ["model_id"])


def append_dead_letters(df: DataFrame, path: str) -> None:
    append(df, path, ["error_type"])


def audit_rows(audits: DataFrame, created_at=None) -> DataFrame:
    """Nested audit records as rows of the audits table, nested parts as JSON."""
    now = created_at if created_at is not None else F.lit(dt.datetime.now(dt.UTC)).cast("timestamp")
    return audits.select(
        "audit_id",
        "model_id",
        "model_version",
        "audit_timestamp",
        "window_start",
        "window_end",
        F.col("sample_size").cast("long").alias("sample_size"),
        "overall_severity",
        F.to_json("metrics").alias("metrics"),
        F.to_json("demographic_slices").alias("demographic_slices"),
        "protected_attributes",
        "triggered_mitigation",
        "mitigation_id",
        now.alias("created_at"),
    )


def append_audits(rows: DataFrame, path: str) -> None:
    """Append rows of the audits table (see ``audit_rows``)."""
    append(rows.withColumn("date", F.to_date("audit_timestamp")), path, ["date"], ["model_id"])


def append_timeseries(series: DataFrame, path: str) -> None:
    append(
        series.withColumn("date", F.to_date("recorded_at")),
        path,
        ["date"],
        ["model_id", "metric_name"],
    )


def mitigation_rows(log: DataFrame) -> DataFrame:
    """Rows of the mitigation table: all its columns, those a log lacks as null, metric maps
    as JSON, and the change of accuracy where both sides are known."""

    def given(field):
        if field.name not in log.columns:
            return F.lit(None).cast("string" if isinstance(field.dataType, T.MapType) else field.dataType)
        return F.to_json(field.name) if isinstance(field.dataType, T.MapType) else F.col(field.name).cast(field.dataType)

    out = log.select(*[given(f).alias(f.name) for f in MITIGATION_LOG.fields])
    change = F.coalesce("accuracy_delta", F.col("accuracy_after") - F.col("accuracy_before"))
    return out.withColumn("accuracy_delta", change)


def append_mitigations(log: DataFrame, path: str) -> None:
    rows = mitigation_rows(log).withColumn("date", F.to_date("triggered_at"))
    append(rows, path, ["date"], ["model_id", "status"])


def mitigation_lookup(table: DataFrame, model_id=None, mitigation_id=None, newest: int | None = None) -> DataFrame:
    """Mitigations of a model, or one of them, newest first."""
    if mitigation_id is not None:
        table = table.where(F.col("mitigation_id") == mitigation_id)
    if model_id is not None:
        table = table.where(F.col("model_id") == model_id)
    out = table.orderBy(F.desc("triggered_at"), "mitigation_id")
    return out if newest is None else out.limit(newest)


def gauge_points(audits: DataFrame) -> DataFrame:
    """Severity gauge points: number, labels and whole seconds."""
    numbers = F.create_map(*[F.lit(x) for kv in SEVERITY_GAUGE.items() for x in kv])
    return audits.select(
        "model_id",
        F.col("overall_severity").alias("severity"),
        "top_metric_name",
        F.coalesce(numbers[F.col("overall_severity")], F.lit(0)).alias("gauge"),
        F.date_trunc("second", "audit_timestamp").alias("end_time"),
    )


def ledger_rows(events: DataFrame, at=None) -> DataFrame:
    """Ledger rows from event_type, model_id, tenant_id, payload and optional
    actor_service_id and ip_address. A single unknown event type fails the whole
    write, so nothing of the batch is kept."""
    known = F.col("event_type").isin(*LEDGER_EVENT_TYPES)
    checked = F.when(known, F.col("event_type")).otherwise(
        F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null"))))
    )

    def given(c, default):
        return F.coalesce(F.col(c), default) if c in events.columns else default

    now = at if at is not None else F.lit(dt.datetime.now(dt.UTC)).cast("timestamp")
    text = F.lit(None).cast("string")
    return events.select(
        # of the event and its time, so that a retried task gives the same id
        F.substring(
            F.sha2(
                F.concat_ws(
                    "|", "event_type", "model_id", "tenant_id", "payload", now.cast("string")
                ),
                256,
            ),
            1,
            32,
        ).alias("EventId"),
        checked.cast("string").alias("EventType"),
        F.col("model_id").alias("ModelId"),
        F.col("tenant_id").alias("TenantId"),
        now.alias("EventTimestamp"),
        F.col("payload").alias("Payload"),
        given("actor_service_id", F.lit("unknown")).alias("ActorServiceId"),
        given("ip_address", text).alias("IpAddress"),
    )


def append_ledger(events: DataFrame, path: str) -> DataFrame:
    """Append events to the ledger and return their ids."""
    rows = ledger_rows(events)
    append(rows.withColumn("date", F.to_date("EventTimestamp")), path, ["date"], ["ModelId", "TenantId"])
    return rows.select("EventId")


def ledger_lookup(ledger: DataFrame, model_id=None, tenant_id=None) -> DataFrame:
    """Ledger events of a model or tenant, newest first."""
    if model_id is not None:
        ledger = ledger.where(F.col("ModelId") == model_id)
    if tenant_id is not None:
        ledger = ledger.where(F.col("TenantId") == tenant_id)
    return ledger.orderBy(F.desc("EventTimestamp"), "EventId")


def breached_names(metrics="metrics") -> F.Column:
    """Names of the breached metrics of a nested audit, in map order."""
    return F.map_keys(F.map_filter(metrics, lambda _, m: m["breached"]))


def audit_completed(audits: DataFrame, tenant_id: str = "default") -> DataFrame:
    """AUDIT_COMPLETED ledger events of nested audit records."""
    payload = F.struct(
        "audit_id",
        "model_id",
        "model_version",
        F.date_format("audit_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("audit_timestamp"),
        "sample_size",
        "overall_severity",
        breached_names().alias("breached_metrics"),
        "triggered_mitigation",
        "mitigation_id",
    )
    return audits.select(
        F.lit("AUDIT_COMPLETED").alias("event_type"),
        "model_id",
        F.lit(tenant_id).alias("tenant_id"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
        F.lit("auditor").alias("actor_service_id"),
    )


def mitigation_triggered(
    audits: DataFrame, mitigation_id, algorithm, tenant_id: str = "default"
) -> DataFrame:
    """MITIGATION_TRIGGERED ledger events of nested audit records."""
    payload = F.struct(
        "audit_id",
        mitigation_id.alias("mitigation_id"),
        "model_id",
        F.col("overall_severity").alias("severity"),
        algorithm.alias("algorithm"),
        breached_names().alias("breached_metrics"),
    )
    return audits.select(
        F.lit("MITIGATION_TRIGGERED").alias("event_type"),
        "model_id",
        F.lit(tenant_id).alias("tenant_id"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
        F.lit("auditor").alias("actor_service_id"),
    )
