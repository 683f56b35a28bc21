"""Streaming alerts on severity gauges."""

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evenhand.operators.alerts import CRITICAL_LEVEL


def immediate_alert_stream(
    points: DataFrame, series, lateness: str = "1 minute", seconds: int = 60
) -> DataFrame:
    """Windows in which a CRITICAL gauge was seen."""
    return (
        points.where(F.col("severity") == "CRITICAL")
        .withWatermark("end_time", lateness)
        .groupBy(F.window("end_time", f"{seconds} seconds"), *series)
        .agg(F.max("gauge").alias("gauge"))
        .where("gauge > 0")
    )


class SustainedAlert(StatefulProcessor):
    """Per series: the run of consecutive firing buckets, and whether it alerted.

    State is three numbers. An alert is emitted when a run first reaches the hold
    time."""

    def __init__(self, seconds: int, hold: int):
        self.seconds, self.hold = seconds, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "first long, last long, alerted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values):
        buckets = sorted({int(b) for pdf in rows for b in pdf["bucket"]})
        first, last, alerted = self.run.get() if self.run.exists() else (None, None, False)
        out = []
        for b in buckets:
            if last is not None and b <= last:
                continue
            if last is None or b != last + 1:
                first, alerted = b, False
            last = b
            if not alerted and (last - first + 1) * self.seconds >= self.hold:
                out.append((*key, first, last))
                alerted = True
        if last is not None:
            self.run.update((first, last, alerted))
        if out:
            yield pd.DataFrame(out, columns=[*self.names(len(key)), "first_bucket", "last_bucket"])

    @staticmethod
    def names(n):
        return [f"k{i}" for i in range(n)]

    def close(self) -> None:
        pass


def sustained_alert_stream(
    points: DataFrame,
    model: str = "model_id",
    lateness: str = "1 minute",
    seconds: int = 60,
    hold: int = 300,
    level: int = CRITICAL_LEVEL,
) -> DataFrame:
    """Alerts when a model's gauge stays above ``level`` for ``hold`` seconds."""
    firing = (
        points.withWatermark("end_time", lateness)
        .groupBy(F.window("end_time", f"{seconds} seconds"), model)
        .agg(F.max("gauge").alias("gauge"))
        .where(F.col("gauge") > level)
        .select(
            model,
            F.col("window.start").alias("at"),
            F.floor(F.unix_seconds("window.start") / seconds).cast("long").alias("bucket"),
        )
    )
    return firing.groupBy(model).transformWithStateInPandas(
        statefulProcessor=SustainedAlert(seconds, hold),
        outputStructType="k0 string, first_bucket long, last_bucket long",
        outputMode="append",
        timeMode="none",
    )
