"""Individual fairness: score distance between alike rows of different groups."""

from pyspark.sql import DataFrame, Window as W, functions as F

from evenhand.operators.cube import unpivot_attributes
from evenhand.session import materialize


def _before(keys, order):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def individual_fairness(df: DataFrame, keys, attributes) -> DataFrame:
    """1 - mean |score difference| over all pairs that share the truth and differ
    in group, clipped to [0, 1]; 1 where there is no such pair."""
    return pair_score(df.withColumn("n", F.lit(1)), keys, attributes)


def pair_score(counted: DataFrame, keys, attributes) -> DataFrame:
    """The score of ``individual_fairness`` from rows that stand for ``n`` equal ones.

    Exact and without forming pairs. Rows collapse to distinct scores of the group
    combinations first, and only then to one list for each attribute. For
    a sorted list, the distances to all earlier rows sum to
    ``score * rows_before - scores_before``; doing that for all rows and
    subtracting the same sum inside the own group leaves the cross-group pairs.
    Cells are ranges of the whole sort key with about as many distinct scores each, so
    they keep any one sort small wherever the scores lie; cell totals give the part of
    each prefix that lies in lower cells."""
    base = [*keys, "attribute", "attribute_ord", "y_true"]
    known = F.col("y_score").isNotNull() & ~F.isnan("y_score") & F.col("y_true").isNotNull()
    combined = counted.where(known).groupBy(*keys, *attributes, "y_true", "y_score").agg(F.sum("n").alias("n"))
    distinct = (
        unpivot_attributes(combined, attributes)
        .groupBy(*base, "y_score", "group_value")
        .agg(F.sum("n").cast("double").alias("w"))
        .withColumn("wx", F.col("w") * F.col("y_score"))
    )
    ranged = distinct.repartitionByRange(*base, "y_score", "group_value")
    distinct = materialize(ranged.withColumn("cell", F.spark_partition_id()), "pair-cells")
    in_cell = _before([*base, "cell"], "y_score")
    in_group = _before([*base, "cell", "group_value"], "y_score")
    others_n = F.coalesce(F.sum("w").over(in_cell), F.lit(0.0)) - F.coalesce(
        F.sum("w").over(in_group), F.lit(0.0)
    )
    others_x = F.coalesce(F.sum("wx").over(in_cell), F.lit(0.0)) - F.coalesce(
        F.sum("wx").over(in_group), F.lit(0.0)
    )
    local = distinct.withColumn("others_n", others_n).withColumn("others_x", others_x)
    cells = local.groupBy(*base, "cell", "group_value").agg(
        F.sum("w").alias("w"),
        F.sum("wx").alias("wx"),
        F.sum(F.col("wx") * F.col("others_n") - F.col("w") * F.col("others_x")).alias("near"),
        F.sum(F.col("w") * F.col("others_n")).alias("near_pairs"),
    )
    below = W.partitionBy(*base).orderBy("cell").rangeBetween(W.unboundedPreceding, -1)
    below_group = (
        W.partitionBy(*base, "group_value").orderBy("cell").rangeBetween(W.unboundedPreceding, -1)
    )

    def lower(c):
        return F.coalesce(F.sum(c).over(below), F.lit(0.0)) - F.coalesce(
            F.sum(c).over(below_group), F.lit(0.0)
        )

    spread = cells.withColumn("lower_n", lower("w")).withColumn("lower_x", lower("wx"))
    distance = F.sum(
        F.col("near") + F.col("wx") * F.col("lower_n") - F.col("w") * F.col("lower_x")
    )
    pairs = F.sum(F.col("near_pairs") + F.col("w") * F.col("lower_n"))
    return (
        spread.groupBy(*keys, "attribute", "attribute_ord")
        .agg(distance.alias("distance"), pairs.alias("pairs"))
        .withColumn(
            "individual_fairness_score",
            F.when(
                F.col("pairs") > 0,
                F.least(
                    F.greatest(1 - F.col("distance") / F.nullif("pairs", F.lit(0.0)), F.lit(0.0)),
                    F.lit(1.0),
                ),
            ).otherwise(F.lit(1.0)),
        )
        .drop("distance")
    )


def sampled_individual_fairness(
    df: DataFrame, keys, attribute: str, row_id: str, pairs: int = 500, seed: int = 42
) -> DataFrame:
    """The same score over ``pairs`` random pairs, drawn by a seeded hash of the row id.

    The smallest hashes per key are drawn; the row limit is applied before the
    shuffle, so a hot key sends only ``2 * pairs`` rows per task."""
    drawn = W.partitionBy(*keys).orderBy("_hash", row_id)
    ranked = (
        df.select(*keys, row_id, attribute, "y_true", "y_score")
        .withColumn("_hash", F.xxhash64(F.lit(seed), F.col(row_id)))
        .withColumn("_rank", F.row_number().over(drawn))
        .where(F.col("_rank") <= 2 * pairs)
    )
    member = F.struct("y_true", F.coalesce(F.col(attribute).cast("string"), F.lit("None")).alias("g"), "y_score")
    drawn_pairs = (
        ranked.groupBy(*keys, F.floor((F.col("_rank") - 1) / 2).alias("pair"))
        .agg(
            F.min_by(member, "_rank").alias("a"),
            F.max_by(member, "_rank").alias("b"),
            F.count(F.lit(1)).alias("members"),
        )
        .withColumn(
            "distance",
            F.when(
                (F.col("members") == 2)
                & (F.col("a.y_true") == F.col("b.y_true"))
                & (F.col("a.g") != F.col("b.g")),
                F.abs(F.col("a.y_score") - F.col("b.y_score")),
            ),
        )
    )
    return drawn_pairs.groupBy(*keys).agg(
        F.count("distance").alias("pairs"),
        F.coalesce(F.lit(1.0) - F.avg("distance"), F.lit(1.0)).alias("individual_fairness_score"),
    )
