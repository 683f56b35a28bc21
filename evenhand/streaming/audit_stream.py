"""Continuous audits: sliding windows, audited as they close.

A window is made of panes, as long as its slide. The stream's state is the leaf of the
audit's lattice for each open pane: rows counted per model, groups, score, prediction,
truth and time. State is keyed by all of these, so a model with a third of all events is
spread like any other, and overlapping windows share their panes. When the watermark has
passed a pane its leaf is stored, and every window that ends there is a roll-up of stored
panes: a whole audit with twelve metrics over all attributes, with intervals.
"""

from pyspark.sql import DataFrame, functions as F

from evenhand.operators import cube, metrics as M
from evenhand.operators.cube import group_text, score_bin
from evenhand.operators.lattice import Lattice
from evenhand.operators.significance import chi_square_columns, p_value
from evenhand.operators.temporal import TICK
from evenhand.schemas import MIN_SAMPLE_SIZE
from evenhand.session import materialize
from evenhand.sources.commits import CommitLog

WINDOW_KEYS = ("model_id", "window_start", "window_end")


def sliding_cube(
    events: DataFrame,
    attributes,
    length: str = "1 hour",
    slide: str = "15 minutes",
    lateness: str | None = "1 hour",
    at: str = "ts",
) -> DataFrame:
    """Joint cube per model and sliding window, on a table or on a stream.

    The state is one count per cell and open window, whatever the event rate.
    A stream emits a window once the watermark has passed its end; later events
    are dropped. On a table leave ``lateness`` at its default, it has no effect."""
    rows = events.select(
        at,
        "model_id",
        *[group_text(a).alias(a) for a in attributes],
        score_bin("y_score").alias("score_bin"),
        "y_pred",
        "y_true",
    )
    if lateness and rows.isStreaming:
        rows = rows.withWatermark(at, lateness)
    counted = rows.groupBy(
        F.window(at, length, slide), "model_id", *attributes, "score_bin", "y_pred", "y_true"
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "model_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *attributes,
        "score_bin",
        "y_pred",
        "y_true",
        "n",
    )


def judge_windows(
    joint: DataFrame, attributes, minimum: int = MIN_SAMPLE_SIZE, compat: bool = False
) -> DataFrame:
    """Judged metrics of closed windows, from the cube alone.

    These are the ten metrics that need no second pass over rows."""
    from evenhand.plans.audit import second_axes

    keys, attributes = list(WINDOW_KEYS), list(attributes)
    ids = [*keys, "attribute", "attribute_ord"]
    groups = cube.group_cube(joint, keys, attributes)
    frame = cube.audit_frame(groups, keys).where(F.col("sample_size") >= minimum)
    sided = cube.with_sides(groups, frame, keys)
    bins = cube.score_bin_cube(joint, frame, keys, attributes)
    facts = sided.groupBy(*ids).agg(*chi_square_columns()).withColumn("p_value", p_value())
    axes = second_axes(attributes, compat)
    wide = (
        M.group_metrics(sided, ids)
        .join(facts, ids)
        .join(M.calibration_gap(bins, ids), ids, "left")
        .join(M.intersectional_bias(joint, keys, attributes, axes), ids, "left")
        .na.fill({"calibration_gap": 0.0})
    )
    return M.long_metrics(wide, ids)


def pane_leaf(
    events: DataFrame, attributes, slide: str = "15 minutes", lateness: str | None = "1 hour", at: str = "ts"
) -> DataFrame:
    """The lattice leaf of each pane, on a table or on a stream.

    Counted by the exact time; ``members`` are the ids and versions of the rows counted
    together, which settle the order of equal times."""
    version = F.col("model_version") if "model_version" in events.columns else F.lit("unknown")
    rows = events.where(cube.READABLE).select(
        F.col(at).alias("ts"),
        "model_id",
        *[group_text(a).alias(a) for a in attributes],
        "y_score",
        "y_pred",
        "y_true",
        F.struct("event_id", version.alias("model_version")).alias("member"),
    )
    if lateness and rows.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    # a stream has one event time; the exact time goes along as a number
    dims = ["model_id", *attributes, "y_score", "y_pred", "y_true"]
    counted = rows.groupBy(F.window("ts", slide).alias("pane"), *dims, F.unix_micros("ts").alias("micros")).agg(
        F.collect_list("member").alias("members")
    )
    return counted.select(
        F.col("pane.start").alias("pane_start"),
        F.col("pane.end").alias("pane_end"),
        *dims,
        F.timestamp_micros("micros").alias("ts"),
        "members",
    )


def _seconds(span: str) -> F.Column:
    return F.expr(f"unix_seconds(timestamp_seconds(0) + INTERVAL {span})")


def window_lattice(panes: DataFrame, attributes, length: str, slide: str, keep=None) -> Lattice:
    """The lattice of all windows over stored panes; ``keep`` picks windows."""
    step = _seconds(slide)
    back = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(_seconds(length) / step) - 1))
    start = F.unix_seconds("pane_start") - F.col("_back") * step
    dealt = (
        panes.withColumn("_back", back)
        .withColumn("window_start", F.timestamp_seconds(start))
        .withColumn("window_end", F.timestamp_seconds(start + _seconds(length)))
    )
    dealt = dealt if keep is None else dealt.where(keep)
    dims = [*WINDOW_KEYS, *attributes, "y_score", "y_pred", "y_true"]
    leaf = dealt.groupBy(*dims, F.date_trunc(TICK, "ts").alias("tick")).agg(
        F.sum(F.size("members")).cast("long").alias("n")
    )
    rows = dealt.select(*dims, "ts", F.inline("members"))
    return Lattice(rows, list(WINDOW_KEYS), attributes, leaf=materialize(leaf, "window-leaf"))


def audit_closed(
    log: CommitLog,
    batch: DataFrame,
    batch_id: int,
    attributes,
    length: str = "1 hour",
    slide: str = "15 minutes",
    tenant_id: str = "default",
    **options,
) -> bool:
    """Store the panes of a batch and audit the windows they close, in one commit.

    Panes, audits, history, ledger and the long metrics appear together or not at all, with
    the time up to which windows are closed; a replayed batch is recognised by its id."""
    from evenhand.plans import audit as A

    name = f"batch-{batch_id:012d}"
    if name in log.names():
        return False
    fresh = materialize(batch, "panes")
    newest = fresh.agg(F.date_format(F.max("pane_end"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    if newest is None:
        return log.commit(name, {}, note=log.last_note())
    before = log.last_note()
    # a pane that was emitted lies behind the watermark, and so does all before its end
    closed = F.col("window_end") <= F.lit(newest).cast("timestamp")
    if before is not None:
        closed &= F.col("window_end") > F.lit(before).cast("timestamp")
    stored = log.read("panes")
    panes = fresh if stored is None else fresh.unionByName(stored.drop("date"))
    if before is not None:
        reach = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {length}")
        panes = panes.where(F.col("pane_end") > reach)
    lattice = window_lattice(panes, attributes, length, slide, closed)
    audits, metrics = A.run_audit(lattice.rows, attributes, keys=WINDOW_KEYS, lattice=lattice, **options)
    tables = A.stored_tables(audits, metrics, tenant_id, WINDOW_KEYS, F.lit(newest).cast("timestamp"))
    tables["audit_metrics"] = metrics.join(audits.select(*WINDOW_KEYS, "audit_id", "audit_timestamp"), list(WINDOW_KEYS))
    tables["panes"] = fresh.withColumn("date", F.to_date("pane_start"))
    return log.commit(name, A.dated(tables), {**A.PARTITIONS, "panes": ["date"]}, note=max(newest, before or ""))


def start_continuous_audit(
    events: DataFrame,
    attributes,
    path: str,
    checkpoint: str,
    length: str = "1 hour",
    slide: str = "15 minutes",
    lateness: str = "1 hour",
    trigger=None,
    **options,
):
    """Audit all models over sliding windows, into the tables of a commit log at ``path``.

    ``length`` is a whole number of slides. ``options`` go to ``plans.audit.audit_metrics``."""
    log = CommitLog(events.sparkSession, path)
    writer = (
        pane_leaf(events, attributes, slide, lateness)
        .writeStream.outputMode("append")
        .foreachBatch(lambda df, k: audit_closed(log, df, k, attributes, length, slide, **options))
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def late_rows(run) -> int:
    """Rows a query has dropped so far because they came after the watermark."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for progress in run.recentProgress
        for op in progress["stateOperators"]
    )
