import numpy as np
import pytest
from pyspark.sql import functions as F

import twins
from evenhand.operators import bootstrap, cube, metrics as M
from evenhand.operators.individual import individual_fairness, sampled_individual_fairness
from evenhand.operators.temporal import TimeCells, temporal_drift, window_gaps
from evenhand.plans.audit import audit_metrics

IDS = ["model_id", "attribute", "attribute_ord"]


def two_groups(positive, truth=(250, 250)):
    """500 of each sex; the first rows of each are predicted and truly positive."""
    rng = np.random.default_rng(1)
    rows = []
    for sex, picked, true in zip(("Male", "Female"), positive, truth):
        for i in range(500):
            p = int(i < picked)
            score = rng.uniform(0.5, 0.95) if p else rng.uniform(0.05, 0.45)
            rows.append((int(i < true), p, float(score), sex))
    return rows


def random_rows(n=700, seed=3, names=("A", "B", None)):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        g = names[rng.integers(len(names))]
        s = float(rng.choice([0.0, 0.1, 0.3, 0.30000000000000004, 0.55, 0.6, 0.7, 0.85, 1.0]))
        p = int(s >= (0.6 if g == "B" else 0.5))
        rows.append((int(rng.random() < 0.3 + 0.4 * s), p, s, g))
    return rows


def frame_of(spark, rows):
    df = spark.createDataFrame(
        [("m", f"e{i:05d}", i // 7, *r) for i, r in enumerate(rows)],
        "model_id string, event_id string, step int, y_true int, y_pred int, y_score double, sex string",
    )
    return df.withColumn("ts", F.timestamp_seconds("step")).withColumn("other", F.col("sex"))


def sided(df, attributes=("sex",)):
    groups = cube.confusion_cube(df, ["model_id"], attributes)
    return cube.with_sides(groups, cube.audit_frame(groups, ["model_id"]), ["model_id"])


def spark_metrics(spark, rows, attribute="sex"):
    df = frame_of(spark, rows)
    joint = cube.joint_cube(df, ["model_id"], [attribute])
    groups = cube.group_cube(joint, ["model_id"], [attribute])
    frame = cube.audit_frame(groups, ["model_id"])
    both = cube.with_sides(groups, frame, ["model_id"])
    out = M.group_metrics(both, IDS).first().asDict()
    bins = cube.score_bin_cube(joint, frame, ["model_id"], [attribute])
    gap = M.calibration_gap(bins, IDS).first()
    out["calibration_gap"] = gap["calibration_gap"] if gap else 0.0
    return out


@pytest.mark.parametrize(
    "positive, expected",
    [
        ((350, 125), {"demographic_parity_difference": 0.45, "disparate_impact_ratio": 0.25 / 0.7,
                      "statistical_parity_subgroup_lift": 2.8, "counterfactual_fairness": 0.45}),
        ((275, 240), {"disparate_impact_ratio": 240 / 275, "demographic_parity_difference": 0.07}),
        ((250, 250), {"demographic_parity_difference": 0.0, "disparate_impact_ratio": 1.0,
                      "statistical_parity_subgroup_lift": 1.0, "equalized_odds_difference": 0.0}),
    ],
)
def test_known_values(spark, positive, expected):
    got = spark_metrics(spark, two_groups(positive))
    for name, value in expected.items():
        assert got[name] == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize(
    "rows, attribute, privileged",
    [
        (two_groups((350, 125)), "sex", "Male"),
        (random_rows(), "other", None),  # most frequent group
        (random_rows(names=("A", "B")), "sex", "Male"),  # privileged group absent
        (random_rows(names=("A",)), "other", "A"),  # one group
        ([(1, 1, 0.9, "Male")] * 60 + [(0, 1, 0.9, "Female")] * 60, "sex", "Male"),
    ],
)
def test_same_as_plain_python(spark, rows, attribute, privileged):
    groups = ["None" if r[3] is None else r[3] for r in rows]
    if privileged is None:
        names = sorted(set(groups))
        privileged = max(names, key=lambda n: (groups.count(n), -names.index(n)))
    want = twins.metrics(*zip(*[r[:3] for r in rows]), groups, privileged)
    got = spark_metrics(spark, rows, attribute)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-9), name


def test_score_bins_are_half_open(spark):
    scores = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.6000000000000001, 0.7, 0.95, 1.0, -0.1, None]
    df = spark.createDataFrame([(s,) for s in scores], "y_score double")
    got = [r[0] for r in df.select(cube.score_bin("y_score")).collect()]
    want = []
    for s in scores:
        hit = [i for i in range(10) if s is not None and twins.EDGES[i] <= s < twins.EDGES[i + 1]]
        want.append(hit[0] if hit else None)
    assert got == want
    assert list(cube.SCORE_EDGES) == list(twins.EDGES)


def test_independent_of_order_and_partitions(spark):
    df = frame_of(spark, random_rows())
    first = M.group_metrics(sided(df), IDS).collect()
    second = M.group_metrics(sided(df.repartition(7).orderBy(F.rand(5))), IDS).collect()
    assert first == second


def test_swapping_sides_inverts_the_impact_ratio(spark):
    df = frame_of(spark, two_groups((350, 125)))
    groups = cube.confusion_cube(df, ["model_id"], ["sex"])
    values = []
    for privileged in ("Male", "Female"):
        frame = cube.audit_frame(groups, ["model_id"], {"sex": privileged})
        both = cube.with_sides(groups, frame, ["model_id"])
        values.append(M.group_metrics(both, IDS, ["disparate_impact_ratio"]).first()[-1])
    assert values[0] * values[1] == pytest.approx(1.0)


def test_user_metric_is_audited(spark):
    M.register(M.GroupMetric("smallest_rate", "min(pred_pos / n)", 0.3, True))
    try:
        df = frame_of(spark, two_groups((350, 125)))
        rows = audit_metrics(df, ["model_id"], ["sex"], pairs=False, history=False, resamples=200)
        row = rows.where("name = 'smallest_rate'").first()
        assert row["value"] == 0.25 and row["breached"] and row["severity"] == "MEDIUM"
        assert row["ci_lower"] < 0.25 < row["ci_upper"]
    finally:
        M._REGISTRY.pop("smallest_rate")


@pytest.mark.parametrize("names", [("A", "B", None), ("A", "B"), ("A",)])
def test_pair_score_is_exact(spark, names):
    rows = random_rows(150, 9, names)
    df = frame_of(spark, rows)
    got = individual_fairness(df, ["model_id"], ["sex"]).first()
    want = twins.pair_score([r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    assert got["individual_fairness_score"] == pytest.approx(want, abs=1e-12)


def test_pair_score_on_distinct_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.random() < 0.5), 1, float(rng.random()), "AB"[rng.integers(2)]) for _ in range(300)]
    got = individual_fairness(frame_of(spark, rows), ["model_id"], ["sex"]).first()
    want = twins.pair_score([r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    assert got["individual_fairness_score"] == pytest.approx(want, abs=1e-12)


def test_pair_sample_is_close_and_repeatable(spark):
    df = frame_of(spark, two_groups((350, 125)))
    exact = individual_fairness(df, ["model_id"], ["sex"]).first()["individual_fairness_score"]
    one = sampled_individual_fairness(df, ["model_id"], "sex", "event_id").first()
    two = sampled_individual_fairness(df.repartition(5), ["model_id"], "sex", "event_id").first()
    assert one == two and one["pairs"] > 50
    assert one["individual_fairness_score"] == pytest.approx(exact, abs=0.06)


@pytest.mark.parametrize("n, unit", [(40, "second"), (130, "second"), (700, "year"), (700, "minute"), (1313, "second")])
def test_temporal_drift(spark, n, unit):
    rows = random_rows(n, 4, ("A", "B"))
    df = frame_of(spark, rows)
    groups = cube.confusion_cube(df, ["model_id"], ["other"])
    frame = cube.audit_frame(groups, ["model_id"])
    privileged = frame.first()["privileged_group"]
    cells = TimeCells(df, ["model_id"], ["other"], ["ts", "event_id"], unit=unit)
    gaps = window_gaps(df, frame, ["model_id"], ["other"], ["ts", "event_id"], cells)
    got = temporal_drift(gaps, ["model_id"]).first()
    want = twins.temporal([r[1] for r in rows], [r[3] for r in rows], privileged)
    assert (got["temporal_drift_index"] if got else 0.0) == pytest.approx(want, abs=1e-9)


def test_intersection_needs_two_groups(spark):
    df = frame_of(spark, [(1, 1, 0.9, "A")] * 20)
    joint = cube.joint_cube(df, ["model_id"], ["sex"])
    got = M.intersectional_bias(joint, ["model_id"], ["sex"], {"sex": "y_true"}).first()
    assert got["intersectional_bias_score"] == 0.0


def test_intervals_contain_the_value_and_match_a_row_bootstrap(spark):
    rows = two_groups((350, 125))
    both = sided(frame_of(spark, rows))
    got = {r["name"]: r for r in bootstrap.group_intervals(both, IDS).collect()}
    point = M.group_metrics(both, IDS).first()
    for name, r in got.items():
        assert r["ci_lower"] - 1e-9 <= point[name] <= r["ci_upper"] + 1e-9, name
    rng = np.random.default_rng(42)
    p = np.array([r[1] for r in rows])
    male = np.array([r[3] == "Male" for r in rows])
    gaps = []
    for _ in range(1000):
        i = rng.integers(0, len(p), len(p))
        gaps.append(abs(p[i][male[i]].mean() - p[i][~male[i]].mean()))
    low, high = np.percentile(gaps, [2.5, 97.5])
    mine = got["counterfactual_fairness"]
    assert mine["ci_lower"] == pytest.approx(low, abs=0.01)
    assert mine["ci_upper"] == pytest.approx(high, abs=0.01)


def test_intervals_do_not_depend_on_partitions(spark):
    both = sided(frame_of(spark, random_rows()))
    order = ["name"]
    one = bootstrap.group_intervals(both, IDS, resamples=100).orderBy(order).collect()
    two = bootstrap.group_intervals(both.repartition(3), IDS, resamples=100).orderBy(order).collect()
    assert one == two


def test_sample_gate(spark):
    df = spark.createDataFrame([("a",)] * 100 + [("b",)] * 99, "model_id string")
    got = {r["model_id"]: r["status"] for r in cube.sample_gate(df, ["model_id"], 100).collect()}
    assert got == {"a": "OK", "b": "INSUFFICIENT_SAMPLE"}


def test_most_frequent_group_ties_to_the_smallest_name(spark):
    df = frame_of(spark, [(1, 1, 0.5, g) for g in "BABAC"])
    frame = cube.audit_frame(cube.confusion_cube(df, ["model_id"], ["other"]), ["model_id"])
    assert frame.first()["privileged_group"] == "A"


def test_hot_group_keeps_every_row(spark):
    rows = [(i % 2, i % 3 == 0, 0.5, "A" if i % 10 else f"g{i}") for i in range(3000)]
    df = frame_of(spark, [(t, int(p), s, g) for t, p, s, g in rows])
    total = cube.confusion_cube(df, ["model_id"], ["sex"]).agg(F.sum("n"), F.count("*")).first()
    assert total[0] == 3000 and total[1] == 301
