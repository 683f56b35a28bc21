"""Event validation: one boolean per rule, and the valid and dead-letter rows."""

from pyspark.sql import DataFrame, functions as F

from evenhand.schemas import MAX_BATCH_EVENTS, USE_CASES
from evenhand.sources.events import event_key, parse_events

_REQUIRED_TEXT = (
    "model_id",
    "model_version",
    "prediction.label",
    "session_context.tenant_id",
    "session_context.use_case",
)
SEPARATOR = "; "
_UNIT_NUMBERS = ("prediction.score", "prediction.threshold")


def _kind(path) -> F.Column:
    """JSON kind of a field: STRING, BIGINT, ..., VOID for null; null if absent."""
    return F.schema_of_variant(F.col(f"event.{path}"))


def _text(path) -> F.Column:
    return F.col(f"event.{path}").cast("string")


def event_time(column) -> F.Column:
    """Timestamp of ISO text or of epoch seconds (milliseconds if very large)."""
    text = F.col(column)
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(F.abs(number) > 2e10, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1000000).cast("long"))).otherwise(
        text.try_cast("timestamp")
    )


def validation_message() -> F.Column:
    """The rules a parsed event breaks, in field order; empty text if none."""
    rules = []

    def rule(name, broken):
        rules.append(F.when(broken, F.lit(name)))

    for path in _REQUIRED_TEXT:
        rule(f"{path}: required", F.coalesce(_kind(path), F.lit("VOID")) == "VOID")
        rule(f"{path}: not a string", ~_kind(path).isin("STRING", "VOID"))
    rule("model_id: contains a space", _text("model_id").contains(" "))
    when = F.col("event.timestamp")
    rule("timestamp: required", when.isNull())
    rule("timestamp: not a time", when.isNotNull() & event_time("event.timestamp").isNull())
    features = F.col("event.features")
    rule("features: required", features.isNull())
    rule(
        "features: not an object",
        features.isNotNull() & (~features.startswith("{") | F.try_parse_json(features).isNull()),
    )
    for path in _UNIT_NUMBERS:
        text = F.col(f"event.{path}")
        number = text.try_cast("double")
        rule(f"{path}: required", text.isNull())
        rule(f"{path}: not a number", text.isNotNull() & (number.isNull() | F.isnan(number)))
        rule(f"{path}: outside 0..1", ~number.between(0.0, 1.0))
    rule("session_context.use_case: unknown", ~_text("session_context.use_case").isin(*USE_CASES))
    rule("event_id: not a string", _kind("event_id") != "STRING")
    rule("ground_truth: not a string", ~_kind("ground_truth").isin("STRING", "VOID"))
    # joining skips rules that hold, and unlike array functions stays compiled
    return F.concat_ws(SEPARATOR, *rules)


def validate(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse and judge messages: adds the event's fields, ``message`` and ``valid``."""
    message = F.when(F.col("corrupt"), "json: cannot be parsed").otherwise(validation_message())
    if "oversized" in messages.columns:
        limit = f"list: more than {MAX_BATCH_EVENTS} events"
        message = F.when(F.col("oversized"), limit).otherwise(message)
    judged = F.struct(
        message.alias("message"),
        _text("event_id").alias("event_id"),
        _text("model_id").alias("model_id"),
        _text("model_version").alias("model_version"),
        event_time("event.timestamp").alias("timestamp"),
        F.col("event.features").alias("features"),
        _text("prediction.label").alias("prediction_label"),
        F.col("event.prediction.score").try_cast("double").alias("prediction_score"),
        F.col("event.prediction.threshold").try_cast("double").alias("prediction_threshold"),
        _text("ground_truth").alias("ground_truth"),
        F.coalesce("event.demographic_tags", F.array().cast("array<string>")).alias(
            "demographic_tags"
        ),
        _text("session_context.tenant_id").alias("tenant_id"),
        _text("session_context.use_case").alias("use_case"),
    )
    # a generator again: the rules run once, whatever filters on their outcome
    return (
        parse_events(messages, raw)
        .select(*messages.columns, "corrupt", F.inline(F.array(judged)))
        .withColumn("valid", F.col("message") == "")
    )


def flatten_valid(judged: DataFrame, ingested_at=None, raw: str = "raw", *position) -> DataFrame:
    """Valid events as rows of the predictions table."""
    return judged.where("valid").select(
        F.coalesce("event_id", event_key(raw, *position)).alias("event_id"),
        "model_id",
        "model_version",
        "timestamp",
        "features",
        "prediction_label",
        "prediction_score",
        "prediction_threshold",
        "ground_truth",
        "demographic_tags",
        "tenant_id",
        "use_case",
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"),
    )


def _oversized(judged: DataFrame):
    return F.col("oversized") if "oversized" in judged.columns else F.lit(False)


def dead_letters(judged: DataFrame, failed_at=None, raw: str = "raw") -> DataFrame:
    """Refused messages, whole, with what was wrong."""
    return judged.where("NOT valid").select(
        F.col(raw).alias("original_message"),
        F.when(F.col("corrupt") & ~_oversized(judged), "JSONDecodeError")
        .otherwise("ValidationError")
        .alias("error_type"),
        F.col("message").alias("error_message"),
        (failed_at if failed_at is not None else F.current_timestamp()).alias("failed_at"),
    )
