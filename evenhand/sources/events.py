"""Prediction events from JSON messages."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evenhand.schemas import EVENT_JSON, MAX_BATCH_EVENTS
from evenhand.session import utc

_CORRUPT = "_corrupt"


def message_stream(spark: SparkSession, fmt: str, path: str | None = None, **options) -> DataFrame:
    """Message source with one text column ``raw``.

    ``kafka`` decodes the payload as UTF-8; ``text`` reads files of one message
    per line."""
    reader = utc(spark).readStream.format(fmt).options(**options)
    df = reader.load(path) if path else reader.load()
    return df.select(F.col("value").cast("string").alias("raw"))


def split_bodies(
    bodies: DataFrame, raw: str = "raw", refuse: bool = False, position: str | None = None
) -> DataFrame:
    """One row per event of bodies that hold one event or a list of events.

    ``batch_size`` is the number of events of the body and ``oversized`` flags
    lists over the limit, which are to be refused whole. With ``refuse`` such a list stays
    one row, for validation to refuse, as does a list that does not parse. ``position`` names
    a column for the event's place in its body."""
    text = F.col(raw)
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    events = F.coalesce(listed, F.array(text))
    held = F.when(F.lit(refuse) & F.col("oversized"), F.array(text)).otherwise(F.col("_events"))
    sized = (
        bodies.withColumn("_events", events)
        .withColumn("batch_size", F.size("_events"))
        .withColumn("oversized", F.col("batch_size") > MAX_BATCH_EVENTS)
    )
    if position is None:
        return sized.withColumn(raw, F.explode(held)).drop("_events")
    kept = [c for c in sized.columns if c not in (raw, "_events")]
    return sized.select(*kept, F.posexplode(held).alias(position, raw))


def parse_events(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse each message once: adds ``event`` and ``corrupt``."""
    schema = T.StructType([*EVENT_JSON.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(raw), schema, {"columnNameOfCorruptRecord": _CORRUPT})
    # a generator, so that filters and projections above do not parse again
    return messages.select("*", F.inline(F.array(F.struct(parsed.alias("event"))))).withColumn(
        "corrupt", F.col("event").isNull() | F.col(f"event.{_CORRUPT}").isNotNull()
    )


def event_key(raw: str = "raw", *position: str) -> F.Column:
    """A stable id for events that bring none: a digest of the message and of its
    position in the source, so a replay gives the same id."""
    return F.substring(F.sha2(F.concat_ws("|", raw, *position), 256), 1, 32)


def new_events(
    rows: DataFrame, model_id: str, model_version: str, tenant_id: str, use_case: str
) -> DataFrame:
    """Build prediction events from feature and prediction columns.

    Fills event_id, timestamp and demographic_tags where absent. ``rows`` has
    ``features`` (JSON text), ``prediction`` (label, score, threshold) and may
    have ground_truth, demographic_tags, timestamp and event_id."""

    def given(c, kind):
        return F.col(c) if c in rows.columns else F.lit(None).cast(kind)

    return rows.select(
        F.coalesce(given("event_id", "string"), F.uuid()).alias("event_id"),
        F.lit(model_id).alias("model_id"),
        F.lit(model_version).alias("model_version"),
        F.coalesce(given("timestamp", "timestamp"), F.current_timestamp()).alias("timestamp"),
        "features",
        "prediction",
        given("ground_truth", "string").alias("ground_truth"),
        F.coalesce(given("demographic_tags", "array<string>"), F.array().cast("array<string>")).alias(
            "demographic_tags"
        ),
        F.struct(F.lit(tenant_id).alias("tenant_id"), F.lit(use_case).alias("use_case")).alias(
            "session_context"
        ),
    )


def event_json(events: DataFrame) -> DataFrame:
    """Events as messages; ``features`` goes in as an object, not as quoted text."""
    features = F.parse_json("features")
    return events.select(
        F.to_json(F.struct(*[features.alias(c) if c == "features" else c for c in events.columns])).alias(
            "raw"
        )
    )
