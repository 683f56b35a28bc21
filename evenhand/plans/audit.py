"""The bias audit: all models and windows of a prediction table in one plan."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from evenhand.operators import bootstrap, cube, metrics as M, severity as V
from evenhand.operators.drift import cusum
from evenhand.operators.lattice import Lattice
from evenhand.operators.significance import chi_square_columns, p_value
from evenhand.operators.slices import demographic_slices, nested_slices
from evenhand.operators.temporal import temporal_drift, window_gaps
from evenhand.schemas import MIN_SAMPLE_SIZE, SEX_SPELLINGS
from evenhand.session import materialize
from evenhand.sources import sinks

# Half widths of the intervals that are not bootstrapped, and the
# range each is clipped to.
CONSTANT_INTERVALS = {
    "individual_fairness_score": (0.05, 1.0),
    "intersectional_bias_score": (0.03, None),
    "temporal_drift_index": (1.0, None),
}


def scan_window(
    predictions: DataFrame,
    demographics: DataFrame | None = None,
    model_id: str | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Labelled predictions of a half-open time range, left-joined to demographics.

    Repeated side rows fan out; reduce them first with ``latest_demographics``
    if that is not wanted. Filters sit below the join so they reach the scan."""
    rows = predictions.where(F.col("ground_truth").isNotNull())
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start))
        if "date" in rows.columns:
            rows = rows.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("timestamp") < F.lit(end))
        if "date" in rows.columns:
            rows = rows.where(F.col("date") <= F.to_date(F.lit(end)))
    if demographics is None:
        return rows
    side = demographics.select("event_id", "gender_distribution", "race_distribution", "age_bin")
    return rows.join(side, "event_id", "left")


def sensitive_columns(rows: DataFrame, attributes=("sex", "gender", "race", "age")) -> DataFrame:
    """Take protected attributes out of the features JSON where they are no column,
    and bring spellings of sex together. Unknown spellings stay as they are."""
    missing = [a for a in attributes if a not in rows.columns]
    out = rows.withColumns({a: F.get_json_object("features", f"$.{a}") for a in missing})
    if "sex" in out.columns:
        spelling = F.create_map(*[F.lit(x) for kv in SEX_SPELLINGS.items() for x in kv])
        out = out.withColumn("sex", F.coalesce(spelling[F.col("sex")], F.col("sex")))
    return out


def label_columns(rows: DataFrame, positive_labels=None) -> DataFrame:
    """Integer truth and prediction and a numeric score.

    With ``positive_labels`` those texts are 1 and all others 0; without, labels
    must read as integers. Rows that do not parse get ``label_error``."""

    def label(c):
        if positive_labels:
            return F.when(F.col(c).isNotNull(), F.col(c).isin(*positive_labels).cast("int"))
        return F.expr(f"try_cast({c} AS int)")

    out = (
        rows.withColumn("y_true", label("ground_truth"))
        .withColumn("y_pred", label("prediction_label"))
        .withColumn("y_score", F.expr("try_cast(prediction_score AS double)"))
    )
    return out.withColumn("label_error", F.col("y_true").isNull() | F.col("y_pred").isNull())


def second_axes(attributes, compat: bool) -> dict:
    """Second axis of the intersectional score: the next protected attribute, or the
    true label when there is no other or ``compat`` asks for it."""
    if compat or len(attributes) < 2:
        return {a: "y_true" for a in attributes}
    return {a: attributes[(i + 1) % len(attributes)] for i, a in enumerate(attributes)}


def audit_lattice(
    rows: DataFrame, keys, attributes, order=("ts", "event_id"), compat=False, secondary=None, history=True
) -> Lattice:
    """The lattice that an audit of these attributes and second axes needs."""
    axes = {**second_axes(attributes, compat), **(secondary or {})}
    extra = [a for a in dict.fromkeys(axes.values()) if a not in (*attributes, "y_true")]
    return Lattice(rows, keys, attributes, extra, order, history)


def audit_metrics(
    rows: DataFrame,
    keys,
    attributes,
    order=("ts", "event_id"),
    compat: bool = False,
    intervals: bool = True,
    minimum: int = MIN_SAMPLE_SIZE,
    resamples: int = bootstrap.RESAMPLES,
    pairs: bool = True,
    history: bool = True,
    privileged: dict | None = None,
    secondary: dict | None = None,
    past: DataFrame | None = None,
    lattice: Lattice | None = None,
) -> DataFrame:
    """All metrics of every key and protected attribute, one judged row each.

    ``rows`` carries the keys, the attributes, y_true, y_pred, y_score and the
    ``order`` columns. Only the leaf of the lattice and the few edge ticks of its time
    windows touch rows; the rest are roll-ups. Keys below the minimum sample are left out (see ``cube.sample_gate``). ``secondary`` overrides
    the second axis of the intersectional score per attribute. ``past`` is a history
    with the keys, recorded_at and metric_value; keys with more than five points
    take their temporal drift from it."""
    keys, attributes = list(keys), cube.present_attributes(rows, attributes)
    ids = [*keys, "attribute", "attribute_ord"]
    axes = {**second_axes(attributes, compat), **(secondary or {})}
    lattice = lattice or audit_lattice(rows, keys, attributes, order, compat, secondary, history)
    joint, groups = lattice.joint, lattice.groups
    frame = cube.audit_frame(groups, keys, privileged).where(F.col("sample_size") >= minimum)
    # one row per group: everything below is small and starts from here
    sided = materialize(cube.with_sides(groups, frame, keys), "sided-groups")
    frame = sided.select(*ids, "privileged_group").distinct()
    bins = cube.score_bin_cube(joint, frame, keys, attributes)
    if intervals:
        bins = materialize(bins, "score-bins")

    names = [m.name for m in M.registered()]
    core = sided.groupBy(*ids).agg(
        F.max("privileged_group").alias("privileged_group"),
        F.expr("coalesce(min(CASE WHEN NOT is_priv THEN group_value END), 'unprivileged')").alias(
            "compared_group"
        ),
        F.expr(M.side("n", True)).alias("privileged_size"),
        F.expr(M.side("n", False)).alias("unprivileged_size"),
        *chi_square_columns(),
        *M.group_metric_columns(names),
    ).withColumn("p_value", p_value())

    def part(df, name):
        return df.select(*ids, F.lit(name).alias("name"), F.col(name).alias("found"))

    found = part(M.calibration_gap(bins, ids), "calibration_gap").unionByName(
        part(M.intersectional_bias(joint, keys, attributes, axes), "intersectional_bias_score")
    )
    # what a metric is worth when there is nothing to compute it from
    empty = {"calibration_gap": 0.0, "intersectional_bias_score": 0.0}
    if pairs:
        name = "individual_fairness_score"
        found = found.unionByName(part(lattice.individual_fairness(), name))
        empty[name] = 1.0
    if history:
        name = "temporal_drift_index"
        gaps = window_gaps(rows, frame, keys, attributes, order, lattice.cells)
        found = found.unionByName(part(temporal_drift(gaps, keys), name))
        empty[name] = 0.0
    carried = ["privileged_group", "compared_group", "privileged_size", "unprivileged_size", "p_value"]
    rowed = M.named_values({**{n: n for n in names}, **{n: f"{v}D" for n, v in empty.items()}})
    long = (
        core.select(*ids, *carried, rowed)
        .join(found, [*ids, "name"], "left")
        .withColumn("value", F.coalesce("found", "value"))
        .drop("found")
    )
    if past is not None:
        long = _drift_from_past(long, past, keys)
    judged = M.judge(long)
    if not intervals:
        none = F.lit(None).cast("double")
        return judged.withColumn("ci_lower", none).withColumn("ci_upper", none)
    drawn = bootstrap.group_intervals(sided, ids, resamples=resamples, point=core).unionByName(
        bootstrap.calibration_intervals(bins, ids, resamples=resamples)
    )
    return constant_intervals(judged.join(drawn, [*ids, "name"], "left"))


def _drift_from_past(long: DataFrame, past: DataFrame, keys) -> DataFrame:
    day = F.to_date("recorded_at")
    known = cusum(past, keys, "recorded_at", "metric_value", day).where("points > 5")
    is_drift = F.col("name") == "temporal_drift_index"
    return (
        long.join(known.select(*keys, F.col("cusum").alias("_past")), keys, "left")
        .withColumn("value", F.when(is_drift, F.coalesce("_past", "value")).otherwise(F.col("value")))
        .drop("_past")
    )


def constant_intervals(long: DataFrame) -> DataFrame:
    """Fill the intervals of the metrics that are not bootstrapped."""
    lower, upper = F.col("ci_lower"), F.col("ci_upper")
    for name, (half, top) in CONSTANT_INTERVALS.items():
        here = F.col("name") == name
        high = F.col("value") + half
        lower = F.when(here, F.greatest(F.col("value") - half, F.lit(0.0))).otherwise(lower)
        upper = F.when(here, F.least(high, F.lit(top)) if top else high).otherwise(upper)
    return long.withColumn("ci_lower", lower).withColumn("ci_upper", upper)


def metric_struct() -> F.Column:
    """A metric row as the nested record of an audit, rounded to six places."""
    return F.struct(
        "name",
        F.round("value", 6).alias("value"),
        "threshold",
        "breached",
        F.array(F.round("ci_lower", 6), F.round("ci_upper", 6)).alias("confidence_interval"),
        "severity",
        F.array("privileged_group", "compared_group").alias("groups_compared"),
        F.array("privileged_size", "unprivileged_size").alias("sample_sizes"),
        F.round("p_value", 6).alias("p_value"),
    )


def audit_results(
    metrics: DataFrame, slices: DataFrame, header: DataFrame, keys, attributes
) -> DataFrame:
    """One nested audit record per key, ready for the audits table.

    ``metrics`` is ``audit_metrics``, ``slices`` the slices per group, ``header``
    the key with sample_size, model_version, window bounds and audit time. The
    audit id is a digest of key and audit time, so a replay writes the same id."""
    keys = list(keys)
    merged = V.last_attribute_wins(metrics, keys)
    severity = V.overall_severity(merged, keys)
    nested = merged.groupBy(*keys).agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("metric_ord", "name", metric_struct().alias("m")))
                ),
                lambda e: F.struct(e["name"], e["m"]),
            )
        ).alias("metrics")
    )
    # groups per audit are as many as the attributes have values
    gathered = nested_slices(slices, keys).groupBy(*keys).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "attribute_ord", F.col("slice.group_value").alias("g"), F.col("slice")
                    )
                ),
                lambda a, b: F.when(a["attribute_ord"] < b["attribute_ord"], -1)
                .when(a["attribute_ord"] > b["attribute_ord"], 1)
                .when(a["g"] < b["g"], -1)
                .when(a["g"] > b["g"], 1)
                .otherwise(0),
            ),
            lambda e: e["slice"],
        ).alias("demographic_slices")
    )
    digest = F.sha2(
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("audit_timestamp").cast("string")),
        256,
    )
    return (
        header.join(severity, keys)
        .join(nested, keys)
        .join(gathered, keys, "left")
        .withColumn("audit_id", F.substring(digest, 1, 32))
        .withColumn("protected_attributes", F.array(*[F.lit(a) for a in attributes]))
        .withColumn("triggered_mitigation", F.lit(False))
        .withColumn("mitigation_id", F.lit(None).cast("string"))
    )


def audit_header(rows: DataFrame, keys, order=("ts", "event_id")) -> DataFrame:
    """Sample size and the model version of the first row by time."""
    rows = rows.where(cube.READABLE)
    version = F.col("model_version") if "model_version" in rows.columns else F.lit("unknown")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.min_by(version, F.struct(*order)).alias("model_version"),
    )


def label_status(rows: DataFrame, keys, minimum: int = MIN_SAMPLE_SIZE) -> DataFrame:
    """Rows of each key, those whose labels could not be read, and why a key is not
    audited or not in full: too few readable rows, or unreadable ones."""
    readable = F.count_if(F.expr(cube.READABLE))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), readable.alias("sample_size"))
    bad = F.col("rows") - F.col("sample_size")
    status = (
        F.when(F.col("sample_size") < minimum, "INSUFFICIENT_SAMPLE")
        .when(bad > 0, "UNREADABLE_LABELS")
        .otherwise("OK")
    )
    return counts.select(*keys, "rows", "sample_size", bad.alias("unreadable"), status.alias("status"))


def run_audit(
    rows: DataFrame,
    attributes,
    start=None,
    end=None,
    audit_time=None,
    keys=("model_id",),
    lattice: Lattice | None = None,
    **options,
) -> tuple:
    """Audit one time window, or many: returns (nested audit records, long metric rows).

    With ``window_start`` and ``window_end`` among the keys each window is an audit of its
    own, audited at its end unless ``audit_time`` says otherwise."""
    keys = list(keys)
    attributes = cube.present_attributes(rows, attributes)
    order = options.get("order", ("ts", "event_id"))
    lattice = lattice or audit_lattice(
        rows, keys, attributes, order, options.get("compat", False), options.get("secondary")
    )
    metrics = materialize(audit_metrics(rows, keys, attributes, lattice=lattice, **options), "audit-metrics")
    slices = demographic_slices(lattice.groups, keys)
    header = lattice.header()
    windowed = "window_end" in keys
    if not windowed:
        header = header.withColumn("window_start", F.lit(start).cast("timestamp")).withColumn(
            "window_end", F.lit(end).cast("timestamp")
        )
    # one time for the whole audit: ids, history and ledger are made from it
    now = F.lit(audit_time or dt.datetime.now(dt.UTC)).cast("timestamp")
    header = header.withColumn("audit_timestamp", F.col("window_end") if windowed and audit_time is None else now)
    audits = audit_results(metrics, slices, header, keys, attributes)
    return materialize(audits, "audits"), metrics


def stored_tables(
    audits: DataFrame, metrics: DataFrame, tenant_id: str = "default", keys=("model_id",), at=None
) -> dict:
    """What the severities of audits call for: rows of the bias_audits, fairness_timeseries
    and ledger tables. LOW audits go to the ledger only. No mitigation is started here."""
    keys = list(keys)
    judged = V.required_action(audits)
    stored = judged.where("log_to_warehouse")
    times = stored.select(*keys, "audit_timestamp")
    merged = V.last_attribute_wins(metrics, keys).join(times, keys)
    events = sinks.audit_completed(judged.where("log_to_ledger"), tenant_id)
    return {
        "bias_audits": sinks.audit_rows(stored, at),
        "fairness_timeseries": timeseries(merged, F.col("audit_timestamp")),
        "ledger": sinks.ledger_rows(events, at),
    }


def persist(audits: DataFrame, metrics: DataFrame, paths: dict, tenant_id: str = "default") -> None:
    """Append audits to the tables their severity calls for.

    ``paths`` names the bias_audits, fairness_timeseries and ledger tables, each appended
    to by itself; ``commit`` writes all of them or none."""
    tables = stored_tables(audits, metrics, tenant_id)
    sinks.append_audits(tables["bias_audits"], paths["bias_audits"])
    sinks.append_timeseries(tables["fairness_timeseries"], paths["fairness_timeseries"])
    sinks.append(dated(tables)["ledger"], paths["ledger"], ["date"], ["ModelId", "TenantId"])


#: Partition columns of the audit tables in a commit log.
PARTITIONS = {t: ["date"] for t in ("bias_audits", "fairness_timeseries", "ledger", "audit_metrics")}


def dated(tables: dict) -> dict:
    """The audit tables with the day that they are laid out by."""
    at = {"bias_audits": "audit_timestamp", "fairness_timeseries": "recorded_at", "ledger": "EventTimestamp", "audit_metrics": "audit_timestamp"}
    return {t: df.withColumn("date", F.to_date(at[t])) if t in at else df for t, df in tables.items()}


def commit(log, name: str, audits: DataFrame, metrics: DataFrame, tenant_id: str = "default", at=None) -> bool:
    """Write an audit's rows to all its tables or to none (see ``sources.commits``); False
    if an audit of that name is there already."""
    return log.commit(name, dated(stored_tables(audits, metrics, tenant_id, at=at)), PARTITIONS)


def timeseries(metrics: DataFrame, recorded_at) -> DataFrame:
    """The long metric history: one row per metric and audit."""
    return metrics.select(
        "model_id",
        F.col("name").alias("metric_name"),
        F.round("value", 6).alias("metric_value"),
        "severity",
        recorded_at.cast("timestamp").alias("recorded_at"),
    )
