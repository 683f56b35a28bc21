"""The stored lattice of an audit: rows are read once, all else is a roll-up.

The leaf counts rows per key, combination of groups, score, prediction, truth and tick of
time. It is written once. Cube, score bins, slices, pair score, time windows and header
are aggregations of it; rows are read again only for the few ticks in which a time window
starts or ends.
"""

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from evenhand.operators import cube
from evenhand.operators.individual import pair_score
from evenhand.operators.temporal import TICK, TimeCells
from evenhand.session import materialize


class Lattice:
    """Roll-ups of one stored aggregate over the readable rows.

    ``extra`` are further columns to count by (second axes that are not protected).
    Without ``history`` times are not counted, and there are no windows. ``leaf`` may hand
    in a leaf that was counted elsewhere, as by a stream."""

    def __init__(
        self,
        rows: DataFrame,
        keys,
        attributes,
        extra=(),
        order=("ts", "event_id"),
        history: bool = True,
        leaf: DataFrame | None = None,
    ):
        if leaf is not None:
            self.leaf = leaf
        self.rows = rows.where(cube.READABLE)
        self.keys, self.attributes, self.extra = list(keys), list(attributes), list(extra)
        self.order, self.history = list(order), history

    @cached_property
    def leaf(self) -> DataFrame:
        groups = [*self.attributes, *self.extra]
        tick = [F.date_trunc(TICK, self.order[0]).alias("tick")] if self.history else []
        rows = self.rows.select(
            *self.keys, *[cube.group_text(a).alias(a) for a in groups], "y_score", "y_pred", "y_true", *tick
        )
        return materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "audit-leaf")

    @cached_property
    def joint(self) -> DataFrame:
        """The joint cube (see ``cube.joint_cube``)."""
        dims = [*self.keys, *self.attributes, *self.extra]
        rolled = self.leaf.groupBy(*dims, cube.score_bin("y_score").alias("score_bin"), "y_pred", "y_true")
        return materialize(rolled.agg(F.sum("n").alias("n")), "joint-cube")

    @cached_property
    def groups(self) -> DataFrame:
        """Confusion counts per key, attribute and group."""
        return cube.group_cube(self.joint, self.keys, self.attributes)

    @cached_property
    def cells(self) -> TimeCells:
        ticks = self.leaf.groupBy(*self.keys, "tick", *self.attributes, "y_pred").agg(F.sum("n").alias("n"))
        return TimeCells(self.rows, self.keys, self.attributes, self.order, ticks)

    def individual_fairness(self) -> DataFrame:
        return pair_score(self.leaf, self.keys, self.attributes)

    def header(self) -> DataFrame:
        """Sample size and the model version of the first row by time."""
        return self.cells.first_versions()
