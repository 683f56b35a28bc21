"""Bias mitigation: weights, repairs, thresholds, constrained training and guards."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from evenhand.operators.cube import group_text
from evenhand.operators.explain import uniform
from evenhand.operators.scan import latest_before, prefix_totals
from evenhand.schemas import METRIC_THRESHOLDS
from evenhand.session import materialize, sized_broadcast

MAX_ACCURACY_DROP = 0.15
ACCURACY_GATE = 0.02
STALE_HOURS = 2


# --- before training ---------------------------------------------------------


def reweighing(rows: DataFrame, keys, attributes, label: str = "y_true") -> DataFrame:
    """Weight table P(group) * P(label) / P(group, label).

    Several attributes form one joint group. Counts come from one aggregation;
    marginals are sums of those few cells."""
    cells = (
        rows.select(*keys, *[group_text(a).alias(a) for a in attributes], label)
        .groupBy(*keys, *attributes, label)
        .agg(F.count(F.lit(1)).alias("cell_n"))
    )
    everything = F.sum("cell_n").over(W.partitionBy(*keys))
    group = F.sum("cell_n").over(W.partitionBy(*keys, *attributes))
    of_label = F.sum("cell_n").over(W.partitionBy(*keys, label))
    return cells.withColumn("weight", group * of_label / (everything * F.col("cell_n")))


def with_weights(rows: DataFrame, weights: DataFrame, keys, attributes, label="y_true") -> DataFrame:
    """Attach weights to rows. The table has one row per group and label."""
    table = sized_broadcast(weights.drop("cell_n"), "weights")
    keyed = table.select(
        *[F.col(c).alias(f"_w_{c}") for c in (*keys, *attributes, label)], "weight"
    )
    match = [F.col(k) == F.col(f"_w_{k}") for k in (*keys, label)]
    match += [group_text(a) == F.col(f"_w_{a}") for a in attributes]
    joined = rows.join(keyed, match, "left")
    return joined.drop(*[f"_w_{c}" for c in (*keys, *attributes, label)])


def training_extract(
    rows: DataFrame, keys, attributes, path: str | None = None, label="y_true"
) -> DataFrame:
    """Labelled rows with weights, optionally written as Parquet."""
    out = with_weights(rows, reweighing(rows, keys, attributes, label), keys, attributes, label)
    if path:
        out.write.mode("append").parquet(path)
    return out


def value_runs(rows: DataFrame, keys, attribute: str, feature: str) -> DataFrame:
    """Distinct values of every group in order: ``value``, its rows ``n`` and the rows
    ``start`` below it, with the group's ``group_n``."""
    ids = [*keys, "group_value"]
    values = (
        rows.select(*keys, group_text(attribute).alias("group_value"), F.col(feature).cast("double").alias("value"))
        .where("value IS NOT NULL AND NOT isnan(value)")
        .groupBy(*ids, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # rows are counted once: sorting into ranges and sizes both start from the values
    values = materialize(values, "values")
    dealt = values.repartitionByRange(*ids, "value").withColumn("cell", F.spark_partition_id())
    runs = prefix_totals(materialize(dealt, "value-cells"), ids, ["value"], {"start": "n"}, "cell")
    sizes = sized_broadcast(values.groupBy(*ids).agg(F.sum("n").alias("group_n")), "group-sizes")
    return runs.withColumn("start", F.col("start").cast("long")).drop("cell").join(sizes, ids)


def repaired_values(runs: DataFrame, keys) -> DataFrame:
    """``target`` of every value: the median over groups of the value at the same rank.

    A value's rank is the middle of its run; its counterpart in a group of another size is
    interpolated between the two rows around the same relative rank."""
    keys = list(keys)
    runs = materialize(runs, "value-runs")
    sizes = runs.groupBy(*keys, F.col("group_value").alias("other")).agg(F.max("group_n").alias("other_n"))
    rank = (F.col("start") + F.col("n") / 2) / F.col("group_n")
    place = F.least(F.greatest(rank * F.col("other_n") - 0.5, F.lit(0.0)), F.col("other_n") - 1.0)
    asked = (
        runs.join(sized_broadcast(sizes, "groups"), keys)
        .where("other <> group_value")
        .select(*keys, F.col("other").alias("group_value"), F.col("group_value").alias("own"), F.col("value").alias("x"), place.alias("place"))
    )
    low = F.floor("place")
    ends = F.explode(F.array(F.struct(low.alias("start"), (1 - (F.col("place") - low)).alias("share")),
                             F.struct(F.ceil("place").alias("start"), (F.col("place") - low).alias("share"))))
    asked = asked.withColumn("end", ends).select(*keys, "group_value", "own", "x", "end.start", "end.share")
    found = latest_before(runs.select(*keys, "group_value", "start", "value"), asked, [*keys, "group_value"], "start", "value")
    # a whole place is asked for twice, with shares one and nothing
    counterparts = found.groupBy(*keys, "own", "x", "group_value").agg(F.sum(F.col("share") * F.col("value")).alias("at_rank"))
    counterparts = counterparts.select(*keys, F.col("own").alias("group_value"), F.col("x").alias("value"), "at_rank")
    own = runs.select(*keys, "group_value", "value", F.col("value").alias("at_rank"))
    return counterparts.unionByName(own).groupBy(*keys, "group_value", "value").agg(F.median("at_rank").alias("target"))


def disparate_impact_repair(
    rows: DataFrame, keys, attribute: str, feature: str, amount: float = 1.0
) -> DataFrame:
    """Move each value towards the median over groups at the same rank.

    Ranks are exact and order within a group is kept. Adds ``<feature>_repaired``; a missing
    value stays missing."""
    targets = repaired_values(value_runs(rows, keys, attribute, feature), keys).select(
        *[F.col(k).alias(f"_q_{k}") for k in keys], F.col("group_value").alias("_q_group"), F.col("value").alias("_q_value"), "target"
    )
    # rows look their value up among the targets of its part, without being sorted
    targets = materialize(targets, "repair-targets").hint("shuffle_hash")
    x = F.col(feature).cast("double")
    match = [F.col(k) == F.col(f"_q_{k}") for k in keys]
    match += [group_text(attribute) == F.col("_q_group"), x == F.col("_q_value")]
    return (
        rows.join(targets, match, "left")
        .withColumn(f"{feature}_repaired", (1 - amount) * x + amount * F.coalesce("target", x))
        .drop("target", "_q_group", "_q_value", *[f"_q_{k}" for k in keys])
    )


# --- after training ----------------------------------------------------------


def threshold_curve(
    rows: DataFrame, keys, attribute: str, resolution: int = 1000, label: str = "y_true"
) -> DataFrame:
    """Counts selected and truly positive at each score threshold, per group.

    Scores fall into ``resolution`` equal levels; a threshold sits at the bottom
    of a level that occurs. All rows count; the curve is at most that long."""
    level = F.floor(F.least(F.greatest("y_score", F.lit(0.0)), F.lit(1.0)) * resolution)
    hist = rows.groupBy(*keys, group_text(attribute).alias("group_value"), level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    down = (
        W.partitionBy(*keys, "group_value")
        .orderBy(F.desc("level"))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    group = W.partitionBy(*keys, "group_value")
    return hist.select(
        *keys,
        "group_value",
        (F.col("level") / resolution).alias("threshold"),
        F.sum("n").over(down).alias("selected"),
        F.sum("pos").over(down).alias("selected_pos"),
        F.sum("n").over(group).alias("group_n"),
        F.sum("pos").over(group).alias("group_pos"),
    )


def exact_curve(rows: DataFrame, keys, attribute: str, label: str = "y_true") -> DataFrame:
    """The same counts at every distinct score, and the ``cell`` of scores it lies in."""
    ids = [*keys, "group_value"]
    hist = rows.groupBy(*keys, group_text(attribute).alias("group_value"), F.col("y_score").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    hist = hist.repartitionByRange(*ids, F.desc("threshold")).withColumn("cell", F.spark_partition_id())
    hist = materialize(hist, "score-cells")
    whole = hist.groupBy(*ids).agg(F.sum("n").alias("group_n"), F.sum("pos").alias("group_pos"))
    known = hist.where("threshold IS NOT NULL AND NOT isnan(threshold)")  # a row without a score is never selected
    upto = prefix_totals(known, ids, [F.desc("threshold")], {"s": "n", "h": "pos"}, "cell")
    return upto.join(sized_broadcast(whole, "group-sizes"), ids).select(
        *ids,
        "threshold",
        (F.col("s") + F.col("n")).cast("long").alias("selected"),
        (F.col("h") + F.col("pos")).cast("long").alias("selected_pos"),
        "group_n",
        "group_pos",
        "cell",
    )


def curve_hull(curve: DataFrame, keys) -> DataFrame:
    """The points of a curve that may be on its upper hull: those on the hull of their cell.

    Upper hulls merge: the hull of the cells' hulls is that of the curve. Both constraints
    look at linear images of (selected, truly positive), which keep hulls."""
    ids = [*keys, "group_value", "cell"]

    def hull(key, pdf):
        order = _upper_hull(pdf["selected"].to_numpy(float), pdf["selected_pos"].to_numpy(float))
        return pdf.iloc[order]

    return curve.groupBy(*ids).applyInPandas(hull, curve.schema).drop("cell")


def _upper_hull(x, y):
    """Indices of the upper convex hull of points, left to right."""
    order = np.lexsort((-y, x))
    hull = []
    for i in order:
        if hull and x[hull[-1]] == x[i]:
            continue
        while len(hull) > 1:
            a, b = hull[-2], hull[-1]
            if (y[b] - y[a]) * (x[i] - x[a]) <= (y[i] - y[a]) * (x[b] - x[a]):
                hull.pop()
            else:
                break
        hull.append(i)
    return np.array(hull)


def _mix(grid, hx, ht):
    """For each grid x: the two hull thresholds around it and the weight of the first."""
    right = np.clip(np.searchsorted(hx, grid, side="left"), 1, len(hx) - 1) if len(hx) > 1 else None
    if right is None:
        same = np.full(len(grid), ht[0])
        return same, same, np.ones(len(grid))
    left = right - 1
    weight = (hx[right] - grid) / (hx[right] - hx[left])
    return ht[left], ht[right], np.clip(weight, 0.0, 1.0)


def _meetings(x, lines):
    """Where two of several functions, straight between the places ``x``, cross."""
    out = []
    for i in range(len(lines)):
        for j in range(i):
            d = lines[i] - lines[j]
            at = np.flatnonzero(d[:-1] * d[1:] < 0)
            out.append(x[at] + d[at] / (d[at] - d[at + 1]) * (x[at + 1] - x[at]))
    return np.concatenate(out) if out else np.zeros(0)


def _choose_thresholds(curve: pd.DataFrame, constraint, objective):
    """Best randomised threshold pair per group under the constraint (Hardt et al.,
    2016), exactly: what is maximised is straight between the corners of the groups' hulls
    and the places where hulls cross, so one of these is best. ``curve`` holds hull points."""
    n, p = 0.0, 0.0
    groups = []
    for g, c in curve.groupby("group_value", sort=True):
        c = c.sort_values("threshold", ascending=False)
        gn, gp = float(c["group_n"].iloc[0]), float(c["group_pos"].iloc[0])
        # a threshold above every score selects nobody
        threshold = np.concatenate(([np.inf], c["threshold"].to_numpy()))
        selected = np.concatenate(([0.0], c["selected"].to_numpy(dtype=float)))
        hits = np.concatenate(([0.0], c["selected_pos"].to_numpy(dtype=float)))
        groups.append((g, gn, gp, threshold, selected, hits))
        n, p = n + gn, p + gp
    neg = n - p
    rows = []
    if constraint == "demographic_parity":
        grid = np.unique(np.concatenate([s / gn for _, gn, _, _, s, _ in groups]))
        total = np.zeros(len(grid))
        mixes = []
        for g, gn, gp, t, s, h in groups:
            true_neg = (gn - gp) - (s - h)
            if objective == "balanced_accuracy_score":
                gain = 0.5 * (h / max(p, 1.0) + true_neg / max(neg, 1.0))
            else:
                gain = (h + true_neg) / n
            x = s / gn
            hull = _upper_hull(x, gain)
            total += np.interp(grid, x[hull], gain[hull])
            mixes.append((g, _mix(grid, x[hull], t[hull])))
        best = int(total.argmax())
        for g, (t0, t1, w) in mixes:
            rows.append((g, float(t0[best]), float(t1[best]), float(w[best]), 0.0, 0.0, float(grid[best]), float(total[best])))
    else:
        hulls = []
        for g, gn, gp, t, s, h in groups:
            fpr, tpr = (s - h) / max(gn - gp, 1.0), h / max(gp, 1.0)
            hull = _upper_hull(fpr, tpr)
            hulls.append((fpr[hull], tpr[hull]))
        corners = np.unique(np.concatenate([[0.0, 1.0], *[x for x, _ in hulls]]))
        grid = np.unique(np.r_[corners, _meetings(corners, [np.interp(corners, x, y) for x, y in hulls])])
        roofs, mixes = [], []
        for g, gn, gp, t, s, h in groups:
            fpr, tpr = (s - h) / max(gn - gp, 1.0), h / max(gp, 1.0)
            hull = _upper_hull(fpr, tpr)
            roofs.append(np.interp(grid, fpr[hull], tpr[hull]))
            mixes.append((g, _mix(grid, fpr[hull], t[hull]), roofs[-1]))
        reach = np.min(roofs, axis=0)
        if objective == "balanced_accuracy_score":
            total = 0.5 * (reach + 1 - grid)
        else:
            total = (reach * p + (1 - grid) * neg) / n
        best = int(total.argmax())
        for g, (t0, t1, w), roof in mixes:
            # groups that could do better are mixed with a coin that shows x
            spare = roof[best] - grid[best]
            ignore = (roof[best] - reach[best]) / spare if spare > 0 else 0.0
            rows.append((g, float(t0[best]), float(t1[best]), float(w[best]), float(ignore), float(grid[best]), float(grid[best]), float(total[best])))
    return rows


_CHOICE = (
    "group_value string, threshold_a double, threshold_b double, weight_a double, "
    "ignore_share double, ignore_rate double, target_rate double, objective double"
)


def choose_thresholds(
    curve: DataFrame,
    keys,
    constraint: str = "demographic_parity",
    objective: str = "accuracy_score",
) -> DataFrame:
    """Threshold pair per group that does best under the constraint, one small task
    per key. Constraints: demographic_parity, equalized_odds. Of a curve with cells
    (``exact_curve``) only the corners of the cells' hulls come together."""
    keys = list(keys)
    curve = curve_hull(curve, keys) if "cell" in curve.columns else curve
    schema = T.StructType(
        [curve.schema[k] for k in keys] + list(T.StructType.fromDDL(_CHOICE).fields)
    )

    def solve(key, pdf):
        rows = _choose_thresholds(pdf, constraint, objective)
        return pd.DataFrame([(*key, *r) for r in rows], columns=schema.names)

    return curve.groupBy(*keys).applyInPandas(solve, schema)


def apply_thresholds(
    rows: DataFrame, choice: DataFrame, keys, attribute: str, row_id: str, seed: int = 42
) -> DataFrame:
    """Fair predictions: adds ``y_fair``. The coin is a hash of the row id."""
    table = sized_broadcast(choice, "thresholds").select(
        *[F.col(k).alias(f"_t_{k}") for k in keys],
        F.col("group_value").alias("_t_group"),
        "threshold_a",
        "threshold_b",
        "weight_a",
        "ignore_share",
        "ignore_rate",
    )
    match = [F.col(k) == F.col(f"_t_{k}") for k in keys] + [group_text(attribute) == F.col("_t_group")]
    picked = F.when(uniform(seed, row_id) < F.col("weight_a"), F.col("threshold_a")).otherwise(
        F.col("threshold_b")
    )
    ignored = uniform(seed + 1, row_id) < F.col("ignore_share")
    coin = uniform(seed + 2, row_id) < F.col("ignore_rate")
    fair = F.when(ignored, coin).otherwise(F.col("y_score") >= picked)
    return (
        rows.join(table, match)
        .withColumn("y_fair", fair.cast("int"))
        .drop(
            *[f"_t_{k}" for k in keys],
            "_t_group",
            "threshold_a",
            "threshold_b",
            "weight_a",
            "ignore_share",
            "ignore_rate",
        )
    )


# --- during training ---------------------------------------------------------


def exponentiated_gradient(
    estimator,
    rows: DataFrame,
    attribute: str,
    label: str = "y_true",
    constraint: str = "demographic_parity",
    eps: float = 0.01,
    max_iter: int = 50,
    step: float = 2.0,
    least_iter: int = 5,
):
    """Reduce constrained training to weighted fits (Agarwal et al., 2018).

    ``estimator`` is a Spark ML classifier that honours ``weightCol`` "_weight"
    and ``labelCol`` "_label". A multiplier per group and direction turns the
    constraint into row costs that depend only on (group, label), so each round
    is one weighted fit and one small aggregation; only group rates reach the
    driver. Rounds end when the rates of the mixture differ by ``eps`` or less, after
    ``least_iter`` at the earliest and ``max_iter`` at the latest. Returns
    [(share, model)], a randomised classifier."""
    data = rows.withColumn("_group", group_text(attribute))
    cells = {
        (r["_group"], int(r[label])): float(r["n"])
        for r in data.groupBy("_group", label).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    total = sum(cells.values())
    odds = constraint == "equalized_odds"
    # one event per conditioning class: everyone, or each true label
    events = sorted({y for _, y in cells}) if odds else [None]
    members = sorted({g for g, _ in cells})
    sides = [(e, g, s) for e in events for g in members for s in (1.0, -1.0)]

    def size(group, event):
        return sum(
            n
            for (g, y), n in cells.items()
            if (group is None or g == group) and (event is None or y == event)
        )

    theta, bound, models = dict.fromkeys(sides, 0.0), 1.0 / eps, []
    gaps = dict.fromkeys(sides, 0.0)
    for _ in range(max_iter):
        top = max(0.0, *theta.values())
        scale = np.exp(-top) + sum(np.exp(v - top) for v in theta.values())
        force = {k: bound * np.exp(v - top) / scale for k, v in theta.items()}
        cost = {}
        for (g, y), _n in cells.items():
            c = 1.0 - 2.0 * y
            for e in events:
                if e is not None and e != y:
                    continue
                pull = {m: force[(e, m, 1.0)] - force[(e, m, -1.0)] for m in members}
                own, everyone = size(g, e), size(None, e)
                c += total * (pull[g] / own - sum(pull.values()) / everyone)
            cost[(g, y)] = c
        weight, target = F.lit(0.0), F.lit(0)
        for (g, y), c in cost.items():
            here = (F.col("_group") == g) & (F.col(label) == y)
            weight = F.when(here, F.lit(abs(float(c)))).otherwise(weight)
            target = F.when(here, F.lit(1 if c < 0 else 0)).otherwise(target)
        model = estimator.fit(
            data.withColumn("_weight", weight).withColumn("_label", target.cast("double"))
        )
        models.append(model)
        rates = {
            (r["_group"], int(r[label])): float(r["pos"])
            for r in model.transform(data)
            .groupBy("_group", label)
            .agg(F.sum("prediction").alias("pos"))
            .collect()
        }
        for e in events:
            here = {k: v for k, v in rates.items() if e is None or k[1] == e}
            overall = sum(here.values()) / size(None, e)
            for g in members:
                rate = sum(v for k, v in here.items() if k[0] == g) / max(size(g, e), 1.0)
                for s in (1.0, -1.0):
                    theta[(e, g, s)] += step / bound * (s * (rate - overall) - eps)
                    gaps[(e, g, s)] += s * (rate - overall)
        if len(models) >= least_iter and max(gaps.values()) <= eps * len(models):
            break
    return [(1.0 / len(models), m) for m in models]


def randomised_predictions(models, rows: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Predict with the mixture: a hash of the row id picks the model per row.

    Adds ``y_fair``."""
    out, floor = rows.withColumn("_u", uniform(seed, row_id)), 0.0
    fair = F.lit(0.0)
    for share, model in models:
        scored = model.transform(out)
        extra = [c for c in scored.columns if c not in out.columns and c != "prediction"]
        here = (F.col("_u") >= floor) & (F.col("_u") < floor + share + 1e-12)
        scored = scored.withColumn(
            "_fair", F.when(here, F.col("prediction")).otherwise(F.col("_fair") if "_fair" in out.columns else fair)
        )
        out, floor = scored.drop("prediction", *extra), floor + share
    return out.withColumn("y_fair", F.col("_fair").cast("int")).drop("_u", "_fair")


# --- choosing and judging ----------------------------------------------------


def select_algorithm(metrics: DataFrame, keys) -> DataFrame:
    """Mitigation per audit from its judged metrics; first rule that holds wins.
    No row where nothing applies."""
    breached = {
        m: F.coalesce(F.max(F.when(F.col("name") == m, F.col("breached"))), F.lit(False))
        for m in METRIC_THRESHOLDS
    }
    impact = F.max(F.when(F.col("name") == "disparate_impact_ratio", F.col("value")))
    # Algorithm, stage and fallback per rule.
    rules = (
        (
            breached["demographic_parity_difference"] & breached["disparate_impact_ratio"],
            ("Reweighing", "pre-processing", "LFR"),
        ),
        (impact < 0.65, ("DisparateImpactRemover", "pre-processing", "Reweighing")),
        (
            breached["equalized_odds_difference"],
            ("AdversarialDebiasing", "in-processing", "PrejudiceRemover"),
        ),
        (
            breached["calibration_gap"],
            ("CalibratedEqOddsPostprocessing", "post-processing", "RejectOptionClassification"),
        ),
        (breached["temporal_drift_index"], ("FullRetrain", "retraining", "SlidingWindowRetrain")),
        (
            breached["intersectional_bias_score"],
            ("MultiGroupReweighing", "pre-processing", "AdversarialDebiasing"),
        ),
    )
    pick = None
    for test, (algorithm, stage, fallback) in rules:
        value = F.struct(
            F.lit(algorithm).alias("algorithm"),
            F.lit(stage).alias("stage"),
            F.lit(fallback).alias("fallback"),
        )
        pick = F.when(test, value) if pick is None else pick.when(test, value)
    return (
        metrics.groupBy(*keys).agg(pick.alias("choice")).where("choice IS NOT NULL").select(*keys, "choice.*")
    )


def fresh_audits(audits: DataFrame, now, hours: float = STALE_HOURS) -> DataFrame:
    """Audits young enough to act on."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("audit_timestamp").cast("double")
    return audits.where(age < hours * 3600)


def improvement(before: DataFrame, after: DataFrame, keys) -> DataFrame:
    """Metrics before and after, matched by name, with percent improvement.

    Distance from the ideal counts: 1 for the ratios and scores, 0 for gaps."""
    ideal_one = F.col("name").isin(
        "disparate_impact_ratio", "individual_fairness_score", "statistical_parity_subgroup_lift"
    )
    ids = [*keys, "name"]
    joined = before.select(*ids, F.col("value").alias("value_before")).join(
        after.select(*ids, F.col("value").alias("value_after")), ids
    )
    ideal = F.when(ideal_one, F.lit(1.0)).otherwise(F.lit(0.0))
    off_before, off_after = (F.abs(F.col(c) - ideal) for c in ("value_before", "value_after"))
    return joined.withColumn(
        "improvement_pct",
        F.when(off_before > 0, 100.0 * (off_before - off_after) / off_before).otherwise(F.lit(0.0)),
    )


def accuracy(rows: DataFrame, keys, prediction: str = "y_pred", label: str = "y_true") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy")
    )


def accuracy_gate(log: DataFrame, largest_drop: float = ACCURACY_GATE) -> DataFrame:
    """Pass mitigations that lose no more accuracy than allowed."""
    return log.withColumn(
        "gate_passed", F.col("accuracy_before") - F.col("accuracy_after") <= largest_drop
    )


def rollback_guard(log: DataFrame, largest_drop: float = MAX_ACCURACY_DROP) -> DataFrame:
    """Decide whether a mitigation is rolled back, and say why.

    ``log`` has accuracy_before, accuracy_after and the metric maps. Negative
    accuracies are an error."""
    limit = abs(largest_drop)
    bad = (F.col("accuracy_before") < 0) | (F.col("accuracy_after") < 0)
    delta = F.when(bad, F.raise_error(F.lit("accuracy cannot be negative"))).otherwise(
        F.col("accuracy_after") - F.col("accuracy_before")
    ).cast("double")
    before, after = F.col("metrics_before"), F.col("metrics_after")
    impact, parity = "disparate_impact_ratio", "demographic_parity_difference"
    improved = F.coalesce(
        F.abs(1 - after[impact]) < F.abs(1 - before[impact]), F.lit(False)
    ) | F.coalesce(after[parity] < before[parity], F.lit(False))
    known = F.coalesce(F.size(before) > 0, F.lit(False)) & F.coalesce(F.size(after) > 0, F.lit(False))
    severe = F.col("accuracy_delta") < -limit
    worse = ~F.col("fairness_improved") & known
    return (
        log.withColumn("accuracy_delta", delta)
        .withColumn("severe_degradation", severe)
        .withColumn("fairness_improved", improved)
        .withColumn("roll_back", F.col("severe_degradation") | worse)
        .withColumn(
            "reason",
            F.when(
                F.col("severe_degradation"),
                F.format_string(
                    f"Undone: an unacceptable accuracy drop, %.2f%% with {limit * 100:.2f}%% allowed",
                    F.abs("accuracy_delta") * 100,
                ),
            )
            .when(worse, "Undone: it failed to improve impact ratio or parity")
            .otherwise("Kept"),
        )
    )


def latest_status(records: DataFrame) -> DataFrame:
    """Current row of each mitigation from its append-only status rows."""
    kept = F.struct(*[c for c in records.columns if c != "mitigation_id"])
    return (
        records.groupBy("mitigation_id")
        .agg(F.max_by(kept, F.struct("recorded_at", "status")).alias("r"))
        .select("mitigation_id", "r.*")
    )


def mitigation_overlay(audits: DataFrame, log: DataFrame) -> DataFrame:
    """Mitigation in force at each audit: the last one triggered before it.

    Both sides are lined up by model and time and the last mitigation is carried
    forward, in day blocks so that no model is one sort."""
    stamps = audits.select(
        "model_id", F.col("audit_timestamp").alias("at"), "audit_id", F.lit(None).cast("string").alias("mitigation_id")
    ).unionByName(
        log.select(
            "model_id",
            F.col("triggered_at").alias("at"),
            F.lit(None).cast("string").alias("audit_id"),
            "mitigation_id",
        )
    )
    day = F.to_date("at")
    # a mitigation at the very time of an audit counts, so it sorts first
    order = [F.col("at"), F.col("mitigation_id").isNull(), F.col("mitigation_id")]
    inside = W.partitionBy("model_id", "_day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    lined = stamps.withColumn("_day", day).withColumn(
        "_local", F.last("mitigation_id", ignorenulls=True).over(inside)
    )
    days = lined.groupBy("model_id", "_day").agg(
        F.max_by("mitigation_id", F.when(F.col("mitigation_id").isNotNull(), F.struct("at", "mitigation_id"))).alias("_end")
    )
    before = W.partitionBy("model_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return (
        lined.where(F.col("audit_id").isNotNull())
        .join(carried, ["model_id", "_day"])
        .select(
            "model_id",
            "audit_id",
            F.col("at").alias("audit_timestamp"),
            F.coalesce("_local", "_carried").alias("mitigation_id"),
        )
    )


def candidate_outcomes(
    rows: DataFrame, keys, attribute: str, privileged: str, shifts, thresholds, label="y_true"
) -> DataFrame:
    """Violations and accuracy of every (shift, threshold) candidate.

    A candidate moves each unprivileged score up by ``shift`` times the gap of
    mean scores, then cuts at the threshold. Rows collapse to distinct scores
    before they meet the candidates, at most fifty."""
    points = (
        rows.select(*keys, (group_text(attribute) == privileged).alias("is_priv"), "y_score", label)
        .groupBy(*keys, "is_priv", "y_score", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    means = points.groupBy(*keys).agg(
        *[
            (
                F.sum(F.when(flag, F.col("n") * F.col("y_score")))
                / F.sum(F.when(flag, F.col("n")))
            ).alias(c)
            for flag, c in ((F.col("is_priv"), "_mean_p"), (~F.col("is_priv"), "_mean_u"))
        ]
    )
    grid = F.array(
        *[
            F.struct(F.lit(float(s)).alias("shift"), F.lit(float(t)).alias("cut"))
            for s in shifts
            for t in thresholds
        ]
    )
    moved = F.col("y_score") + F.when(
        F.col("is_priv"), F.lit(0.0)
    ).otherwise(F.col("shift") * (F.col("_mean_p") - F.col("_mean_u")))
    tried = points.join(means, list(keys)).select(
        "*", F.inline(grid)
    ).withColumn("picked", moved >= F.col("cut"))

    def total(flag):
        return F.sum(F.when(flag, F.col("n")).otherwise(F.lit(0)))

    priv, picked, true = F.col("is_priv"), F.col("picked"), F.col(label) == 1
    sums = tried.groupBy(*keys, "shift", "cut").agg(
        F.sum("n").alias("n"),
        total(picked == true).alias("right"),
        total(priv & picked).alias("pos_p"),
        total(priv).alias("n_p"),
        total(~priv & picked).alias("pos_u"),
        total(~priv).alias("n_u"),
        total(priv & picked & true).alias("tp_p"),
        total(priv & true).alias("t_p"),
        total(~priv & picked & true).alias("tp_u"),
        total(~priv & true).alias("t_u"),
    )

    def rate(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    gap = F.abs(rate("pos_p", "n_p") - rate("pos_u", "n_u"))
    miss = F.abs(rate("tp_p", "t_p") - rate("tp_u", "t_u"))
    over = F.greatest(gap - METRIC_THRESHOLDS["demographic_parity_difference"], F.lit(0.0)) + F.greatest(
        miss - METRIC_THRESHOLDS["equal_opportunity_difference"], F.lit(0.0)
    )
    return sums.select(
        *keys, "shift", "cut", over.alias("violations"), (F.col("right") / F.col("n")).alias("accuracy")
    )


def pareto_front(candidates: DataFrame, keys) -> DataFrame:
    """Candidates that no other beats on both violations and accuracy."""
    by = W.partitionBy(*keys).orderBy("violations")
    better = F.max("accuracy").over(by.rangeBetween(W.unboundedPreceding, W.currentRow))
    # the best accuracy among strictly fewer violations
    first = F.min("violations").over(W.partitionBy(*keys, "accuracy"))
    return (
        candidates.withColumn("_best", better)
        .withColumn("_least", first)
        .where((F.col("accuracy") >= F.col("_best")) & (F.col("violations") <= F.col("_least")))
        .drop("_best", "_least")
    )


def compare_versions(
    metrics: DataFrame, accuracies: DataFrame, keys, current, candidate, largest_drop=ACCURACY_GATE
) -> DataFrame:
    """A/B verdict between two model versions.

    Passes when the candidate breaches no more metrics and does not lose more
    accuracy than allowed. Both tables carry ``model_version``."""
    breaches = metrics.groupBy(*keys, "model_version").agg(
        F.count_if("breached").cast("long").alias("n_breached")
    )
    both = breaches.join(accuracies, [*keys, "model_version"])

    def pick(version, c):
        return F.max(F.when(F.col("model_version") == version, F.col(c)))

    return (
        both.groupBy(*keys)
        .agg(
            pick(current, "n_breached").alias("breached_a"),
            pick(candidate, "n_breached").alias("breached_b"),
            pick(current, "accuracy").alias("accuracy_a"),
            pick(candidate, "accuracy").alias("accuracy_b"),
        )
        .withColumn(
            "ab_result",
            F.when(
                (F.col("breached_b") <= F.col("breached_a"))
                & (F.col("accuracy_a") - F.col("accuracy_b") <= largest_drop),
                "pass",
            ).otherwise("fail"),
        )
    )
