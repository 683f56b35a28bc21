"""Running totals and row numbers that scale past one task per key.

A plain window over a hot key puts all its rows in one task. Here the order is
cut into blocks: running totals inside each block, totals per block, then a
small running total over blocks.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from evenhand.session import materialize

_BEFORE = (W.unboundedPreceding, -1)


def running_before(column, keys, order):
    """Sum of ``column`` over the rows strictly before this one."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(*_BEFORE)
    return F.coalesce(F.sum(column).over(w), F.lit(0).cast("double"))


def prefix_totals(df: DataFrame, keys, order, measures: dict, block: str) -> DataFrame:
    """Add exclusive running totals of ``measures`` (result name -> column).

    ``block`` must grow with ``order`` and be computed from the row alone."""
    local = df.withColumns(
        {name: running_before(F.col(c), [*keys, block], order) for name, c in measures.items()}
    )
    totals = df.groupBy(*keys, block).agg(
        *[F.sum(c).cast("double").alias(f"_t_{name}") for name, c in measures.items()]
    )
    offsets = totals.select(
        *keys,
        block,
        *[
            running_before(F.col(f"_t_{name}"), keys, [block]).alias(f"_o_{name}")
            for name in measures
        ],
    )
    joined = local.join(offsets, [*keys, block])
    return joined.withColumns(
        {name: F.col(name) + F.col(f"_o_{name}") for name in measures}
    ).drop(*[f"_o_{name}" for name in measures])


def row_index(df: DataFrame, keys, order, label: str = "row-index") -> DataFrame:
    """Number rows 0.. within ``keys`` by ``order``; adds ``row_no`` and ``key_rows``.

    Rows are range-partitioned on the whole sort key, so neither a hot key nor a
    hot instant lands in one task. The sorted rows are written once; partition
    starts are then derived from that table, never from a second sort."""
    numbered = materialize(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id()),
        label,
    ).withColumn("_part", F.shiftright("_pos", 33))
    parts = numbered.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_start")
    )
    everything = W.partitionBy(*keys)
    offsets = parts.select(
        *keys,
        "_part",
        "_start",
        F.coalesce(
            F.sum("_rows").over(everything.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)
        ).alias("_offset"),
        F.sum("_rows").over(everything).alias("key_rows"),
    )
    return (
        numbered.join(offsets, [*keys, "_part"])
        .withColumn("row_no", F.col("_pos") - F.col("_start") + F.col("_offset"))
        .drop("_pos", "_part", "_start", "_offset")
    )


def latest_before(known: DataFrame, asked: DataFrame, keys, at: str, value: str) -> DataFrame:
    """``asked`` with the ``value`` of the last row of ``known`` whose ``at`` is not above its
    own, within ``keys``: an as-of join.

    Both sides are dealt by ranges of (keys, at) and walked in order inside a range; what a
    range inherits is a small running look-up over the ranges before it, so neither a hot
    key nor a long series lands in one task."""
    kept = [c for c in asked.columns if c not in (*keys, at)]
    sides = known.select(*keys, at, F.lit(0).alias("_asks"), F.col(value).alias("_known")).unionByName(
        asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True
    )
    dealt = materialize(
        sides.repartitionByRange(*keys, at, "_asks").withColumn("_range", F.spark_partition_id()), "as-of"
    )
    inside = W.partitionBy(*keys, "_range").orderBy(at, "_asks")
    seen = F.last("_known", ignorenulls=True).over(inside)
    ends = dealt.groupBy(*keys, "_range").agg(
        F.max(F.when(F.col("_asks") == 0, F.struct(at, F.col("_known")))).alias("_end")
    )
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(*_BEFORE)
    ends = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(before)["_known"].alias("_carried"))
    found = dealt.withColumn("_seen", seen).where("_asks = 1").join(ends, [*keys, "_range"])
    return found.select(*keys, at, *kept, F.coalesce("_seen", "_carried").alias(value))
