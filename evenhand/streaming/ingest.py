"""Streaming ingest: parse, validate, enrich, redact and write."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from evenhand.operators.enrich import enrich
from evenhand.operators.privacy import redact_predictions
from evenhand.operators.validate import dead_letters, flatten_valid, validate
from evenhand.session import keyed_state
from evenhand.sources.events import split_bodies
from evenhand.streaming.redelivery import settle_deliveries


def write_batch(messages: DataFrame, batch_id: int, paths: dict, key: str) -> None:
    """Write one micro-batch to the three tables.

    A message holds one event or a list of events; a list over the limit is refused
    whole. The judged batch is kept in memory for the three writes. Tables are laid out
    by date (or error) first, so that a time range lists few folders, and by batch below;
    a replay overwrites just its own folders. Files are balanced by size."""
    # events without an id are told apart by their message and their place in it, or, where
    # messages have no id, by their place in the batch
    if "message_id" in messages.columns:
        events = split_bodies(messages.select("message_id", "raw"), refuse=True, position="_pos")
        events = events.withColumn("_place", F.concat_ws("-", "message_id", "_pos")).drop("message_id", "_pos")
    else:
        place = F.concat_ws("-", F.lit(str(batch_id)), F.monotonically_increasing_id())
        events = split_bodies(messages.select("raw"), refuse=True).withColumn("_place", place)
    judged = validate(events).persist()
    try:
        now = F.lit(dt.datetime.now(dt.UTC)).cast("timestamp")
        valid = flatten_valid(judged, now, "raw", "_place")
        # enrich and redact both read the valid rows
        tables = {
            "predictions": redact_predictions(valid, key).withColumn("date", F.to_date("timestamp")),
            "demographics": enrich(valid, now).withColumn("date", F.to_date("timestamp")),
            "dead_letters": dead_letters(judged, now),
        }
        partition = {"predictions": "date", "demographics": "date", "dead_letters": "error_type"}
        for name, df in tables.items():
            (
                df.withColumn("batch", F.lit(batch_id).cast("long"))
                .hint("rebalance", partition[name])
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(partition[name], "batch")
                .parquet(paths[name])
            )
    finally:
        judged.unpersist()


def write_deliveries(outcomes: DataFrame, batch_id: int, paths: dict, key: str) -> None:
    """Write one micro-batch of settled deliveries: accepted and dead messages to the three
    tables, failed ones to ``retries`` with the time they are due again."""
    outcomes = outcomes.persist()
    try:
        write_batch(outcomes.where("outcome IN ('accepted', 'dead')"), batch_id, paths, key)
        (
            outcomes.where("outcome = 'retry'")
            .select("message_id", "raw", "attempt", "due_at", F.to_date("due_at").alias("date"))
            .withColumn("batch", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "batch")
            .parquet(paths["retries"])
        )
    finally:
        outcomes.unpersist()


def start_ingest(
    messages: DataFrame, paths: dict, checkpoint: str, key: str, trigger=None, lateness: str = "1 hour"
):
    """Start the ingest query over a message stream with a ``raw`` column.

    ``paths`` names the predictions, demographics and dead_letters tables. Where messages
    have a ``message_id`` and a delivery time ``at``, a message is taken once however often
    it is delivered within ``lateness``; one that does not parse is due again with growing
    delay (table ``retries``) and becomes a dead letter after the fifth delivery."""
    write = write_batch
    if {"message_id", "at"} <= set(messages.columns):
        failed = F.try_parse_json("raw").isNull()
        messages = settle_deliveries(messages.withColumn("failed", failed), lateness)
        write = write_deliveries
    writer = messages.writeStream.foreachBatch(
        lambda df, batch_id: write(df, batch_id, paths, key)
    ).option("checkpointLocation", checkpoint)
    with keyed_state(messages.sparkSession):
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def drop_duplicates(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop redelivered events; state is kept for ``lateness`` only."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])
