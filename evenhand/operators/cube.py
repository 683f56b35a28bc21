"""The confusion cube: one distributed pass from which most of the audit follows.

``joint_cube`` counts rows per model (and window), combination of group values, score
bin, prediction and truth; an audit takes it from its stored lattice. Every
per-attribute table below is a re-aggregation of those counts.
"""

import logging

from pyspark.sql import DataFrame, functions as F

from evenhand.schemas import PRIVILEGED_GROUPS

# Lower edges of the ten score bins, and the upper end, as doubles.
SCORE_EDGES = (
    0.0,
    0.1,
    0.2,
    0.30000000000000004,
    0.4,
    0.5,
    0.6000000000000001,
    0.7000000000000001,
    0.8,
    0.9,
    1.0,
)

COUNTS = ("n", "pred_pos", "true_pos", "tp", "fp", "tn", "fn")


def group_text(column) -> F.Column:
    """A group value as text; a missing value is a group of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def score_bin(score: str) -> F.Column:
    """Index of the half-open bin holding ``score``; null outside [0, 1)."""
    # last edge not above the score
    edges = " ".join(f"WHEN {score} >= {e!r}D THEN {i}" for i, e in reversed([*enumerate(SCORE_EDGES[:-1])]))
    return F.expr(f"CASE WHEN {score} >= 1 THEN NULL {edges} END")


#: Rows whose truth and prediction could be read; only these are counted.
READABLE = "y_true IS NOT NULL AND y_pred IS NOT NULL"


def present_attributes(df: DataFrame, attributes) -> list:
    """Protected attributes that are columns of ``df``, in the order asked for; the others
    are named in a warning."""
    if absent := [a for a in attributes if a not in df.columns]:
        logging.getLogger("evenhand").warning("attributes not in the data, left out: %s", ", ".join(absent))
    return [a for a in attributes if a in df.columns]


def joint_cube(df: DataFrame, keys, attributes, bins: bool = True) -> DataFrame:
    """Row counts per key, group combination, score bin, prediction and truth."""
    dims = [group_text(a).alias(a) for a in attributes]
    if bins:
        dims.append(score_bin("y_score").alias("score_bin"))
    return (
        df.where(READABLE)
        .select(*keys, *dims, "y_pred", "y_true")
        .groupBy(*keys, *attributes, *(["score_bin"] if bins else []), "y_pred", "y_true")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unpivot_attributes(df: DataFrame, attributes) -> DataFrame:
    """One row per attribute: ``attribute``, its position and the group value."""
    entries = ", ".join(
        f"named_struct('attribute', '{a}', 'attribute_ord', {i}, "
        f"'group_value', coalesce(CAST(`{a}` AS string), 'None'))"
        for i, a in enumerate(attributes)
    )
    kept = [c for c in df.columns if c not in attributes]
    return df.select(*kept, F.expr(f"inline(array({entries}))"))


def _sum_where(condition: str, name: str) -> F.Column:
    return F.expr(f"sum(if({condition}, n, 0))").alias(name)


def confusion_counts() -> list:
    """Aggregates turning joint-cube cells into confusion counts."""
    pred, true = "y_pred <=> 1", "y_true <=> 1"
    return [
        F.sum("n").alias("n"),
        _sum_where(pred, "pred_pos"),
        _sum_where(true, "true_pos"),
        _sum_where(f"{pred} AND {true}", "tp"),
        _sum_where(f"{pred} AND NOT {true}", "fp"),
        _sum_where(f"NOT {pred} AND NOT {true}", "tn"),
        _sum_where(f"NOT {pred} AND {true}", "fn"),
    ]


def group_cube(joint: DataFrame, keys, attributes) -> DataFrame:
    """Confusion counts per key, attribute and group."""
    return (
        unpivot_attributes(joint, attributes)
        .groupBy(*keys, "attribute", "attribute_ord", "group_value")
        .agg(*confusion_counts())
    )


def confusion_cube(df: DataFrame, keys, attributes) -> DataFrame:
    """Confusion counts straight from prediction rows."""
    return group_cube(joint_cube(df, keys, attributes, bins=False), keys, attributes)


def intersectional_cube(joint: DataFrame, keys, pairs) -> DataFrame:
    """Confusion counts per cross-product group, all attribute pairs in one pass.

    ``pairs`` are (attribute, attribute) tuples; the group is ``a_b`` and the
    attribute ``A×B``."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f"{a}×{b}").alias("attribute"),
                F.lit(i).alias("attribute_ord"),
                F.concat(group_text(a), F.lit("_"), group_text(b)).alias("group_value"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return (
        joint.select(*keys, "y_pred", "y_true", "n", F.inline(entries))
        .groupBy(*keys, "attribute", "attribute_ord", "group_value")
        .agg(*confusion_counts())
    )


def contingency(groups: DataFrame, keys) -> DataFrame:
    """Group by prediction table in long form."""
    return groups.select(
        *keys,
        "attribute",
        "group_value",
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("y_pred"), (F.col("n") - F.col("pred_pos")).alias("cell_n")
                ),
                F.struct(F.lit(1).alias("y_pred"), F.col("pred_pos").alias("cell_n")),
            )
        ),
    )


def audit_frame(groups: DataFrame, keys, privileged=None) -> DataFrame:
    """One row per key and attribute: totals, privileged and compared group.

    The privileged group is the conventional one for the attribute, else the
    most frequent group with ties going to the smallest name."""
    fixed = {**PRIVILEGED_GROUPS, **(privileged or {})}
    known = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    id_cols = [*keys, "attribute", "attribute_ord"]
    totals = groups.groupBy(*id_cols).agg(
        F.sum("n").alias("sample_size"),
        F.sum("pred_pos").alias("sample_pos"),
        F.count(F.lit(1)).alias("group_count"),
        F.min(F.struct((-F.col("n")).alias("c"), F.col("group_value").alias("g")))["g"].alias(
            "most_frequent"
        ),
    )
    return totals.withColumn(
        "privileged_group", F.coalesce(known[F.col("attribute")], F.col("most_frequent"))
    ).drop("most_frequent")


def with_sides(groups: DataFrame, frame: DataFrame, keys) -> DataFrame:
    """Attach the audit totals to each group and flag the privileged one."""
    return groups.join(frame, [*keys, "attribute", "attribute_ord"]).withColumn(
        "is_priv", F.col("group_value") == F.col("privileged_group")
    )


def score_bin_cube(joint: DataFrame, frame: DataFrame, keys, attributes) -> DataFrame:
    """Rows and positives per score bin on the two sides of each attribute.

    Scores outside the bins (1.0 included) belong to none."""
    cells = (
        unpivot_attributes(joint.where(F.col("score_bin").isNotNull()), attributes)
        .groupBy(*keys, "attribute", "attribute_ord", "group_value", "score_bin")
        .agg(
            F.sum("n").alias("n"),
            _sum_where("y_true <=> 1", "true_pos"),
        )
    )
    return (
        with_sides(cells, frame, keys)
        .groupBy(*keys, "attribute", "attribute_ord", "score_bin")
        .agg(
            F.expr("sum(if(is_priv, n, 0))").alias("n_priv"),
            F.expr("sum(if(is_priv, true_pos, 0))").alias("true_priv"),
            F.expr("sum(if(is_priv, 0, n))").alias("n_unpriv"),
            F.expr("sum(if(is_priv, 0, true_pos))").alias("true_unpriv"),
        )
    )


def sample_gate(df: DataFrame, keys, minimum: int) -> DataFrame:
    """Sample size and status per key; small samples are reported, not failed."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size")).withColumn(
        "status",
        F.when(F.col("sample_size") >= minimum, "OK").otherwise("INSUFFICIENT_SAMPLE"),
    )


def latest_demographics(demographics: DataFrame) -> DataFrame:
    """Reduce an append-only side table to the newest row per event."""
    kept = F.struct(*[c for c in demographics.columns if c != "event_id"])
    newest = F.max_by(kept, "enriched_at").alias("r")
    return demographics.groupBy("event_id").agg(newest).select("event_id", "r.*")
