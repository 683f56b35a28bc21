"""Temporal drift of the group gap over row-count windows in time order."""

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from evenhand.operators.cube import group_text, unpivot_attributes
from evenhand.operators.drift import DRIFT_SLACK, cusum_of_array
from evenhand.operators.scan import prefix_totals, row_index
from evenhand.session import materialize, sized_broadcast

SMALLEST_WINDOW = 50
#: Times are counted by this unit; rows within one unit are looked up only where a window
#: starts or ends inside it.
TICK = "second"


def overlapping_windows(rows, row_no) -> tuple:
    """First and last window holding row ``row_no`` of ``rows`` rows.

    A window is a tenth of the rows (50 at least) and each starts half a window
    after the one before. Rows in no window get last < first."""
    size = F.greatest(F.floor(rows / 10), F.lit(SMALLEST_WINDOW))
    step = F.floor(size / 2)
    first = F.greatest(F.lit(0), F.ceil((row_no - size + 1) / step))
    # short input has no window at all
    newest = F.when(rows >= size, F.floor((rows - size) / step)).otherwise(-1)
    return first.cast("long"), F.least(F.floor(row_no / step), newest).cast("long")


def tick_counts(rows: DataFrame, keys, attributes, at: str, unit: str = TICK) -> DataFrame:
    """Row counts per key, ``tick`` of time, groups and prediction."""
    groups = [group_text(a).alias(a) for a in attributes]
    return (
        rows.select(*keys, F.date_trunc(unit, at).alias("tick"), *groups, "y_pred")
        .groupBy(*keys, "tick", *attributes, "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


class TimeCells:
    """The rows of every key in time order, as running totals of counted ticks.

    Ticks are dealt into cells by a range partition over (key, time), so cells hold about
    as many ticks each wherever in time a key's rows lie: a model with an hour of rows and
    one with six years of them are cut alike. Running totals of the ticks tell which rows
    lie in which windows, except in ticks with a window edge inside; only the rows of those
    (and of each key's first tick) are read, and put in exact order.

    ``order`` is the time column and what settles equal times; ``ticks`` is ``tick_counts``
    or a roll-up of something finer."""

    def __init__(self, rows: DataFrame, keys, attributes, order, ticks: DataFrame | None = None, unit: str = TICK):
        self.rows, self.keys, self.attributes, self.order = rows, list(keys), list(attributes), list(order)
        self.unit, self.dims = unit, [*attributes, "y_pred"]
        self.ticks = tick_counts(rows, keys, attributes, order[0], unit) if ticks is None else ticks

    @cached_property
    def counts(self) -> DataFrame:
        """Rows per key, tick, groups and prediction, with the cell the tick lies in."""
        dealt = self.ticks.where("tick IS NOT NULL").repartitionByRange(*self.keys, "tick")
        return materialize(dealt.withColumn("cell", F.spark_partition_id()), "time-cells")

    @cached_property
    def placed(self) -> DataFrame:
        """Where each tick's rows stand in their key, and the windows of its first and last."""
        sizes = self.counts.groupBy(*self.keys, "cell", "tick").agg(F.sum("n").alias("rows"))
        started = prefix_totals(sizes, self.keys, ["tick"], {"start": "rows"}, "cell")
        whole = sized_broadcast(sizes.groupBy(*self.keys).agg(F.sum("rows").alias("key_rows")), "key-rows")

        def windows_at(row):
            found = overlapping_windows(F.col("key_rows"), row)
            return F.struct(found[0].alias("first_window"), found[1].alias("last_window"))

        started = started.withColumn("start", F.col("start").cast("long")).join(whole, self.keys)
        return materialize(
            started.withColumn("head", windows_at(F.col("start"))).withColumn(
                "tail", windows_at(F.col("start") + F.col("rows") - 1)
            ),
            "time-ticks",
        )

    @cached_property
    def read_rows(self) -> DataFrame:
        """The rows of ticks with a window edge inside, and of each key's first tick."""
        # at most about three edges per window, sixty per key
        some = self.placed.where("head <> tail OR start = 0").select(
            *self.keys, "tick", "start", "key_rows", (F.col("head") != F.col("tail")).alias("is_edge")
        )
        some = sized_broadcast(some.withColumnRenamed("key_rows", "all_rows"), "edge-ticks")
        versions = ["model_version"] if "model_version" in self.rows.columns else []
        rows = self.rows.select(
            *self.keys,
            *self.order,
            F.date_trunc(self.unit, self.order[0]).alias("tick"),
            *[group_text(a).alias(a) for a in self.attributes],
            "y_pred",
            *[v for v in versions if v not in self.order],
        )
        # written first: range partitioning reads its input twice
        return materialize(rows.join(some, [*self.keys, "tick"]), "edge-rows")

    def spans(self) -> DataFrame:
        """Row counts per (first window, last window, groups, prediction)."""
        keys, dims = self.keys, self.dims
        whole = self.counts.join(self.placed.where("head = tail").drop("cell"), [*keys, "tick"]).select(
            *keys, "head.first_window", "head.last_window", *dims, "n"
        )
        indexed = row_index(self.read_rows.where("is_edge"), [*keys, "tick"], self.order)
        first, last = overlapping_windows(F.col("all_rows"), F.col("start") + F.col("row_no"))
        edges = indexed.select(
            *keys, first.alias("first_window"), last.alias("last_window"), *dims, F.lit(1).cast("long").alias("n")
        )
        return (
            whole.unionByName(edges)
            .where("last_window >= first_window")
            .groupBy(*keys, "first_window", "last_window", *dims)
            .agg(F.sum("n").alias("n"))
        )

    def first_versions(self) -> DataFrame:
        """Sample size and the model version of the first row by time of every key."""
        version = F.col("model_version") if "model_version" in self.rows.columns else F.lit("unknown")
        return self.read_rows.where("start = 0").groupBy(*self.keys).agg(
            F.max("all_rows").alias("sample_size"),
            F.min_by(version, F.struct(*self.order)).alias("model_version"),
        )


def window_gaps(
    df: DataFrame, frame: DataFrame, keys, attributes, order, cells: TimeCells | None = None
) -> DataFrame:
    """|selection rate gap| per window where both sides are present."""
    spans = (cells or TimeCells(df, keys, attributes, order)).spans()
    moved = unpivot_attributes(spans, attributes).withColumn(
        "window_no", F.explode(F.sequence("first_window", "last_window"))
    )
    ids = [*keys, "attribute", "attribute_ord"]
    priv = F.col("group_value") == F.col("privileged_group")

    def total(flag, positive):
        keep = flag & (F.col("y_pred") == 1) if positive else flag
        return F.sum(F.when(keep, F.col("n")).otherwise(F.lit(0)))

    return (
        moved.join(frame.select(*ids, "privileged_group"), ids)
        .groupBy(*ids, "window_no")
        .agg(
            total(priv, False).alias("n_p"),
            total(priv, True).alias("pos_p"),
            total(~priv, False).alias("n_u"),
            total(~priv, True).alias("pos_u"),
        )
        .where("n_p > 0 AND n_u > 0")
        .withColumn("gap", F.abs(F.col("pos_p") / F.col("n_p") - F.col("pos_u") / F.col("n_u")))
    )


def temporal_drift(gaps: DataFrame, keys, slack: float = DRIFT_SLACK) -> DataFrame:
    """CUSUM over the window gaps, 0 with fewer than three windows.

    There are about nineteen windows per audit whatever its size."""
    series = F.transform(
        F.array_sort(F.collect_list(F.struct("window_no", "gap"))), lambda w: w["gap"]
    )
    return gaps.groupBy(*keys, "attribute", "attribute_ord").agg(
        F.count(F.lit(1)).alias("windows"), series.alias("gaps")
    ).withColumn("temporal_drift_index", cusum_of_array("gaps", slack=slack))
