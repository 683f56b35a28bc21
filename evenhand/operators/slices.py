"""Per-group slices of the confusion cube."""

from pyspark.sql import DataFrame, functions as F


def _over(num, *den) -> F.Column:
    total = F.col(den[0])
    for d in den[1:]:
        total = total + F.col(d)
    return F.col(num) / F.greatest(total, F.lit(1))


def demographic_slices(groups: DataFrame, keys) -> DataFrame:
    """Count, rates and confusion measures per group; an empty denominator gives 0."""
    return groups.select(
        *keys,
        "attribute",
        "attribute_ord",
        "group_value",
        F.col("n").alias("count"),
        _over("pred_pos", "n").alias("positive_rate"),
        _over("true_pos", "n").alias("base_rate"),
        _over("tp", "tp", "fn").alias("true_positive_rate"),
        _over("fp", "fp", "tn").alias("false_positive_rate"),
        _over("tn", "tn", "fp").alias("true_negative_rate"),
        _over("fn", "fn", "tp").alias("false_negative_rate"),
        _over("tp", "tp", "fp").alias("precision"),
        ((F.col("tp") + F.col("tn")) / F.greatest(F.col("n"), F.lit(1))).alias("accuracy"),
    )


# Measure names of a slice, in report order.
SLICE_MEASURES = (
    "count",
    "positive_rate",
    "base_rate",
    "true_positive_rate",
    "false_positive_rate",
    "true_negative_rate",
    "false_negative_rate",
    "precision",
    "accuracy",
)


def nested_slices(slices: DataFrame, keys, extra: dict | None = None) -> DataFrame:
    """One struct column ``slice`` per group, measures rounded to six places.

    ``extra`` adds or overrides scalar measures (name -> Column)."""
    measures = F.map_from_arrays(
        F.array(*[F.lit(m) for m in SLICE_MEASURES]),
        F.array(*[F.round(F.col(m).cast("double"), 6) for m in SLICE_MEASURES]),
    )
    if extra:
        names = F.array(*[F.lit(k) for k in extra])
        base = F.map_filter(measures, lambda k, _: ~F.array_contains(names, k))
        added = F.map_from_arrays(names, F.array(*[v.cast("double") for v in extra.values()]))
        measures = F.map_concat(base, added)
    return slices.select(
        *keys,
        "attribute_ord",
        F.struct(
            "attribute",
            "group_value",
            F.col("count").cast("long").alias("count"),
            F.round("positive_rate", 6).alias("positive_rate"),
            measures.alias("metrics"),
        ).alias("slice"),
    )


def heatmap(intersections: DataFrame, keys, first: str, second: str, values) -> DataFrame:
    """Selection rate matrix: rows are groups of ``first``, columns of ``second``."""
    return (
        intersections.groupBy(*keys, first)
        .pivot(second, list(values))
        .agg(F.sum("pred_pos") / F.sum("n"))
    )
