"""Feature attribution and counterfactual search for scored rows."""

from pyspark.sql import DataFrame, Window as W, functions as F

from evenhand.operators.cube import group_text
from evenhand.session import materialize, sized_broadcast

# Relative changes tried per feature, in order.
PERTURBATIONS = (0.1, 0.2, 0.3, -0.1, -0.2, -0.3)
MOST_COUNTERFACTUALS = 5
BACKGROUND_COPIES = 50


def _features(names, value) -> F.Column:
    """One struct per feature: position, name and ``value(name)``."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("feature_ord"),
                F.lit(n).alias("feature"),
                value(n).cast("double").alias("value"),
            )
            for i, n in enumerate(names)
        ]
    )


def linear_attribution(rows: DataFrame, keys, coefficients: dict, kept=()) -> DataFrame:
    """Exact attribution of a linear or logistic model: weight * (x - mean of x).

    Long form: keys, kept columns, feature_ord, feature, value. The means are one
    row per key and travel to the rows, so rows are not shuffled."""
    means = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in coefficients])
    means = sized_broadcast(means, "feature-means")
    entries = _features(
        coefficients, lambda c: F.lit(float(coefficients[c])) * (F.col(c) - F.col(f"_m_{c}"))
    )
    return rows.join(means, list(keys)).select(*keys, *kept, F.inline(entries))


def importance(attribution: DataFrame, keys) -> DataFrame:
    """Mean absolute attribution per feature and its rank per key."""
    ranked = W.partitionBy(*keys).orderBy(F.desc("importance"), "feature_ord")
    return (
        attribution.groupBy(*keys, "feature_ord", "feature")
        .agg(F.avg(F.abs("value")).alias("importance"))
        .withColumn("rank", F.row_number().over(ranked))
    )


def group_importance(attribution: DataFrame, keys, attribute: str) -> DataFrame:
    """Mean absolute attribution per feature and group."""
    return attribution.groupBy(*keys, group_text(attribute).alias("group_value"), "feature").agg(
        F.avg(F.abs("value")).alias("importance")
    )


def attribution_summary(
    attribution: DataFrame, keys, n_features: int, sensitive: str | None = None, top: int = 5
) -> DataFrame:
    """Per key: top features in rank order, the sensitive feature's share, rows
    explained, and mean, deviation and largest absolute attribution."""
    ranks = importance(attribution, keys)
    is_sensitive = F.col("feature") == F.lit(sensitive)
    tops = ranks.groupBy(*keys).agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "feature")))
            ),
            lambda r: r["feature"],
        ).alias("top_features"),
        F.max(F.when(is_sensitive, F.col("importance"))).alias("sensitive_importance"),
        F.max(F.when(is_sensitive, F.col("rank"))).alias("sensitive_rank"),
    )
    totals = attribution.groupBy(*keys).agg(
        (F.count("value") / n_features).cast("long").alias("rows_explained"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.max(F.abs("value")).alias("max_abs"),
    )
    return tops.join(totals, list(keys))


def uniform(seed: int, *columns) -> F.Column:
    """Repeatable uniform number in [0, 1) from a hash of columns."""
    h = F.xxhash64(F.lit(seed), *columns)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def shapley_attribution(
    rows: DataFrame,
    row_id: str,
    features,
    score,
    background: DataFrame,
    permutations: int = 8,
    seed: int = 42,
    background_rows: int | None = None,
) -> DataFrame:
    """Shapley values of any model by random feature orders.

    ``score`` maps a DataFrame with the features to one with ``output`` added,
    such as a fitted pipeline's transform. Each row walks from a background row
    to itself in several random orders, one feature at a time; the change of the
    output is credited to the feature just switched.

    The whole ``background`` takes part, or, with ``background_rows``, a sample of about
    so many rows drawn by a hash of their values."""
    names = list(features)
    base = materialize(background.select(*names), "background-rows")
    if background_rows is not None:
        share = background_rows / max(base.count(), 1)
        base = base.where(uniform(seed + 2, *names) < share)
    base = materialize(base.withColumn("_id", F.monotonically_increasing_id()), "background-ids")
    # rows get numbers from 0 by part and place, so that no task holds them all
    part = F.shiftright("_id", 33)
    parts = base.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    first = parts.withColumn("_first", F.expr("sum(_n) OVER (ORDER BY _part) - _n"))
    numbered = base.join(F.broadcast(first), part == F.col("_part")).select(  # a row for each file
        (F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).alias("_bg"),
        F.array(*[F.col(c).cast("double") for c in names]).alias("_base"),
    )
    numbered = sized_broadcast(numbered, "background")
    size = numbered.count()
    walks = (
        rows.select(row_id, F.array(*[F.col(c).cast("double") for c in names]).alias("_x"))
        .withColumn("_walk", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        .withColumn("_bg", F.pmod(F.xxhash64(F.lit(seed), row_id, "_walk"), F.lit(size)) + 1)
        .join(numbered, "_bg")
        # dealt by row while they are few: the steps made below then stay where they are made,
        # and are scored and added up without another shuffle
        .repartition(row_id)
    )
    # random order of features: sort positions by a hash
    order = F.transform(
        F.array_sort(
            F.array(
                *[
                    F.struct(F.xxhash64(F.lit(seed + 1), row_id, "_walk", F.lit(i)).alias("h"), F.lit(i).alias("i"))
                    for i in range(len(names))
                ]
            )
        ),
        lambda e: e["i"],
    )
    steps = walks.withColumn("_order", order).withColumn(
        "_step", F.explode(F.sequence(F.lit(0), F.lit(len(names))))
    )
    switched = F.slice("_order", F.lit(1), F.col("_step"))
    mixed = steps.select(
        row_id,
        "_walk",
        "_order",
        "_step",
        *[
            F.when(F.array_contains(switched, F.lit(i)), F.col("_x")[i])
            .otherwise(F.col("_base")[i])
            .alias(c)
            for i, c in enumerate(names)
        ],
    )
    walked = score(mixed).select(row_id, "_walk", "_order", "_step", "output")
    # a walk has one row per step, a handful
    outputs = walked.groupBy(row_id, "_walk").agg(
        F.array_sort(F.collect_list(F.struct("_step", "output"))).alias("_o"),
        F.first("_order").alias("_order"),
    )
    gains = outputs.select(
        row_id,
        F.posexplode("_order").alias("_pos", "feature_ord"),
        "_o",
    ).withColumn("gain", F.col("_o")[F.col("_pos") + 1]["output"] - F.col("_o")[F.col("_pos")]["output"])
    label = F.array(*[F.lit(c) for c in names])
    return gains.groupBy(row_id, "feature_ord").agg(F.avg("gain").alias("value")).select(
        row_id, "feature_ord", label[F.col("feature_ord")].alias("feature"), "value"
    )


def perturbation_grid(rows: DataFrame, features, kept) -> DataFrame:
    """Each row once per feature and relative change, that feature changed."""
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("feature_ord"),
                F.lit(f).alias("feature"),
                F.lit(j).alias("change_ord"),
                F.lit(d).alias("change"),
            )
            for i, f in enumerate(features)
            for j, d in enumerate(PERTURBATIONS)
        ]
    )
    tried = rows.select(*kept, *features, F.inline(grid))
    changed = {
        f: F.when(F.col("feature") == f, F.col(f) * (1 + F.col("change"))).otherwise(F.col(f))
        for f in features
    }
    before = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features])
    return tried.withColumn("from_value", before.cast("double")).withColumns(changed).withColumn(
        "to_value", F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features]).cast("double")
    )


def counterfactuals(
    rows: DataFrame, row_id: str, features, predict, desired: int = 1, original: str = "y_pred"
) -> DataFrame:
    """First five single-feature changes that flip each row to ``desired``.

    Features and changes are tried in order; ``predict`` adds ``prediction``.
    Only rows not already there are searched. One row per change found."""
    # dealt by row before the changes are made, which then are judged where they are made
    wanting = rows.where(F.col(original) != desired).repartition(row_id)
    flips = predict(perturbation_grid(wanting, features, [row_id])).where(
        F.col("prediction") == desired
    )
    found = F.struct(
        "feature_ord",
        "change_ord",
        "feature",
        F.round("from_value", 4).alias("from_value"),
        F.round("to_value", 4).alias("to_value"),
        F.round(F.col("to_value") - F.col("from_value"), 4).alias("delta"),
    )
    # at most one entry per feature and change in a group
    return (
        flips.groupBy(row_id)
        .agg(F.slice(F.array_sort(F.collect_list(found)), 1, MOST_COUNTERFACTUALS).alias("c"))
        .select(row_id, F.posexplode("c").alias("found_no", "c"))
        .select(row_id, (F.col("found_no") + 1).alias("found_no"), "c.*")
        .drop("feature_ord", "change_ord")
        .withColumn("n_changes", F.lit(1))
        .withColumn("predicted_outcome", F.lit(desired))
    )


def change_summary(found: DataFrame, keys=()) -> DataFrame:
    """How often each feature changes over counterfactuals, most frequent first."""
    order = W.partitionBy(*keys).orderBy(F.desc("times"), "feature")
    return (
        found.groupBy(*keys, "feature")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= 3")
    )


def describe_changes(pairs: DataFrame, row_id: str, features) -> DataFrame:
    """Changed features between ``f`` and ``f_new`` columns: from, to, delta, and
    how many; fewest changes first within a row."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f).eqNullSafe(F.col(f"{f}_new")),
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.round(F.col(f).cast("double"), 4).alias("from_value"),
                        F.round(F.col(f"{f}_new").cast("double"), 4).alias("to_value"),
                        F.round((F.col(f"{f}_new") - F.col(f)).cast("double"), 4).alias("delta"),
                    ),
                )
                for f in features
            ]
        )
    )
    fewest = W.partitionBy(row_id)
    return (
        pairs.withColumn("changes", entries)
        .withColumn("n_changes", F.size("changes"))
        .withColumn("min_changes_required", F.min("n_changes").over(fewest))
    )


def background_around(
    rows: DataFrame, row_id: str, features, predict, copies: int = BACKGROUND_COPIES, seed: int = 42
) -> DataFrame:
    """Copies of each row, every feature scaled by a repeatable uniform(0.5, 1.5),
    labelled by ``predict``."""
    # dealt by row before the copies are made: they then stay, and are judged, where they are made
    noisy = rows.select(row_id, *features).repartition(row_id).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(1), F.lit(copies)))
    )
    return predict(
        noisy.withColumns(
            {f: F.col(f) * (0.5 + uniform(seed, row_id, "copy_no", F.lit(f))) for f in features}
        )
    )
