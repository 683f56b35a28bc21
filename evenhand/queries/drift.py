"""Drift queries over daily gaps and monthly metric histories."""

from pyspark.sql import functions as F

from evenhand.operators import cube, drift as D
from evenhand.plans.history import drift_statistics, drift_view as view_of_model
from evenhand.queries import query
from evenhand.queries.views import P, predictions
from evenhand.session import materialize

_KEYS = ("model_id",)

# Gap of selection rates between the two sexes per model and day.
DAILY = (
    P
    + """,
d0 AS (SELECT model_id, ts AS day, sex, avg(y_pred) AS r FROM p GROUP BY ALL),
daily AS (SELECT model_id, day, max(r) - min(r) AS gap FROM d0 GROUP BY ALL)"""
)


def daily_gaps(spark, folder):
    rows = predictions(spark, folder).withColumnRenamed("ts", "day")
    groups = cube.confusion_cube(rows, ["model_id", "day"], ["sex"])
    rate = F.col("pred_pos") / F.col("n")
    gaps = groups.groupBy("model_id", "day").agg((F.max(rate) - F.min(rate)).alias("gap"))
    return materialize(gaps, "daily-gaps")  # a short series that every detector walks


_STEPS = """
b AS (SELECT *, {goal} AS goal, row_number() OVER w AS rn, count(*) OVER (PARTITION BY model_id) AS points
      FROM daily WINDOW w AS (PARTITION BY model_id ORDER BY day)),
i AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE gap - goal - 0.05 END AS up,
             CASE WHEN rn = 1 THEN 0 ELSE goal - gap - 0.05 END AS down FROM b),
c AS (SELECT *, sum(up) OVER w AS cu, sum(down) OVER w AS cd FROM i WINDOW w AS (PARTITION BY model_id ORDER BY day)),
l AS (SELECT *, min(cu) OVER w AS lu, min(cd) OVER w AS ld FROM c WINDOW w AS (PARTITION BY model_id ORDER BY day))
SELECT model_id, points, round(CASE WHEN points < 3 THEN 0 ELSE greatest(max(cu - lu), max(cd - ld)) END, 6) AS cusum
FROM l GROUP BY model_id, points"""


@query(f"WITH {DAILY}, {_STEPS.format(goal='min(gap) OVER (PARTITION BY model_id)')}")
def cusum(spark, folder):
    out = D.cusum(daily_gaps(spark, folder), _KEYS, "day", "gap", F.date_trunc("month", "day"))
    return out.withColumn("cusum", F.round("cusum", 6))


@query(f"WITH {DAILY}, {_STEPS.format(goal='0.4')}")
def cusum_with_target(spark, folder):
    out = D.cusum(
        daily_gaps(spark, folder), _KEYS, "day", "gap", F.date_trunc("month", "day"), target=0.4
    )
    return out.withColumn("cusum", F.round("cusum", 6))


# Mean gap per model and week: a history that drifts little and one that does.
# One weekly history, model after model, so that its level shifts.
WEEKLY = (
    P
    + """,
d0 AS (SELECT model_id, date_trunc('week', ts) AS day, sex, avg(y_pred) AS r FROM p GROUP BY ALL),
weekly AS (SELECT model_id, day, max(r) - min(r) AS gap FROM d0 GROUP BY ALL)"""
)


def weekly_gaps(spark, folder):
    rows = predictions(spark, folder).withColumn("week", F.date_trunc("week", "ts"))
    groups = cube.confusion_cube(rows, ["model_id", "week"], ["sex"])
    rate = F.col("pred_pos") / F.col("n")
    gaps = groups.groupBy("model_id", "week").agg((F.max(rate) - F.min(rate)).alias("gap"))
    series = gaps.select(
        F.lit("all").alias("series"),
        F.concat("model_id", F.lit(" "), F.date_format("week", "yyyy-MM-dd")).alias("at"),
        "gap",
    )
    return materialize(series, "weekly-gaps")


@query(
    f"""WITH {WEEKLY},
t AS (SELECT 'all' AS series, row_number() OVER (ORDER BY model_id, day) - 1 AS ln, count(*) OVER () AS n, gap,
        coalesce(sum(gap) OVER (ORDER BY model_id, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ls,
        sum(gap) OVER () AS total FROM weekly),
h AS (SELECT *, n >= 10 AND ln >= n // 4 AND ln < 3 * n // 4 AND ln >= 3 AND n - ln >= 3
        AND abs(ls / ln - (total - ls) / (n - ln)) >= sqrt(ln(4 / 0.002) / (2 / (1.0 / ln + 1.0 / (n - ln)))) AS hit
      FROM t)
SELECT series, max(n) AS points, bool_or(coalesce(hit, false)) AS drift_detected,
  coalesce(array_to_string((array_agg(ln ORDER BY ln) FILTER (hit))[1:5], ','), '') AS drift_points,
  round(avg(gap) FILTER (ln >= n - CAST(ceil(n / 4) AS BIGINT)), 6) AS current_mean,
  round(avg(gap) FILTER (ln < n // 4), 6) AS historical_mean
FROM h GROUP BY series"""
)
def adwin(spark, folder):
    # the block is a prefix of the order column
    out = D.adwin(weekly_gaps(spark, folder), ["series"], "at", "gap", F.substring("at", 1, 12))
    return out.select(
        "series",
        "points",
        "drift_detected",
        F.array_join(F.col("drift_points").cast("array<string>"), ",").alias("drift_points"),
        F.round("current_mean", 6).alias("current_mean"),
        F.round("historical_mean", 6).alias("historical_mean"),
    )


def _segments(penalty, jump=5, shortest=2):
    """Brute force over relation ``ser`` (series, i, gap, place): the best cost up to every
    multiple of ``jump`` from all starts before it, then the way back from the end."""
    cost = """(x.ss[{t} + 1] - x.ss[{s} + 1]) - (x.s[{t} + 1] - x.s[{s} + 1]) * (x.s[{t} + 1] - x.s[{s} + 1]) / ({t} - {s})"""
    step, last = cost.format(s=f"({jump} * j)", t=f"({jump} * (k + 1))"), cost.format(s=f"({jump} * j)", t="x.n")
    return f"""
pre AS (SELECT series, i, place, gap, sum(gap) OVER w AS cs, sum(gap * gap) OVER w AS css FROM ser WINDOW w AS (PARTITION BY series ORDER BY i)),
x AS (SELECT series, count(*) AS n, list_prepend(0.0, list(cs ORDER BY i)) AS s, list_prepend(0.0, list(css ORDER BY i)) AS ss,
    list(place ORDER BY i) AS ats FROM pre GROUP BY series),
dp AS (SELECT series, CAST(0 AS BIGINT) AS k, [CAST(-{penalty} AS DOUBLE)] AS f, [CAST(NULL AS BIGINT)] AS back FROM x WHERE n >= 10
  UNION ALL SELECT series, k + 1, list_append(f, b.v), list_append(back, b.j) FROM (
    SELECT x.series, k, f, back, list_min(list_transform(range(0, k + 1), lambda j: {{'v': f[j + 1] + {step} + {penalty}, 'j': j}})) AS b
    FROM dp JOIN x USING (series) WHERE {jump} * (k + 1) < x.n)),
fin AS (SELECT x.series, back, ats, list_min(list_transform(range(0, (x.n - {shortest}) // {jump} + 1), lambda j: {{'v': f[j + 1] + {last}, 'j': j}})).j AS j
  FROM dp JOIN x USING (series) WHERE {jump} * (k + 1) >= x.n),
walk AS (SELECT series, j, back, ats FROM fin UNION ALL SELECT series, back[j + 1], back, ats FROM walk WHERE back[j + 1] > 0),
cuts AS (SELECT series, CAST({jump} * j AS BIGINT) AS changepoint, ats[{jump} * j + 1] AS "at" FROM walk WHERE j > 0)"""


@query(
    f"""WITH RECURSIVE {WEEKLY},
ser AS (SELECT 'all' AS series, row_number() OVER (ORDER BY model_id, day) - 1 AS i, gap, model_id || ' ' || strftime(day, '%Y-%m-%d') AS place FROM weekly),
{_segments(0.5)} SELECT series, changepoint, "at" FROM cuts"""
)
def changepoints(spark, folder):
    return D.changepoints(weekly_gaps(spark, folder), ["series"], "at", "gap", penalty=0.5)


@query(
    f"""WITH RECURSIVE {DAILY},
ser AS (SELECT model_id AS series, row_number() OVER (PARTITION BY model_id ORDER BY day) - 1 AS i, gap, strftime(day, '%Y-%m-%d') AS place FROM daily),
{_segments(0.12)} SELECT series AS model_id, changepoint, "at" FROM cuts"""
)
def changepoints_daily(spark, folder):
    """The daily history of each model, at a penalty that gives many segments."""
    out = D.changepoints(daily_gaps(spark, folder), _KEYS, "day", "gap", penalty=0.12)
    return out.select("model_id", "changepoint", F.date_format("at", "yyyy-MM-dd").alias("at"))


# the running statistics over relation ``o`` (model_id, i, gap), one row at a time
_SIGMA = """
st AS (SELECT model_id, i, CAST(1 AS BIGINT) AS n, gap AS mean, CAST(0 AS DOUBLE) AS m2, false AS hit FROM o WHERE i = 0
  UNION ALL
  SELECT model_id, i, CASE WHEN hit THEN 1 ELSE n END, CASE WHEN hit THEN gap ELSE mean END, CASE WHEN hit THEN 0 ELSE m2 END, hit
  FROM (SELECT *, n > 3 AND sqrt(m2 / (n - 1)) > 0 AND abs(gap - mean) > 2.0 * sqrt(m2 / (n - 1)) AS hit
    FROM (SELECT model_id, i, gap, n, mean, m2p + (gap - prev) * (gap - mean) AS m2
      FROM (SELECT o.model_id, o.i, o.gap, st.n + 1 AS n, st.mean AS prev, st.m2 AS m2p,
              st.mean + (o.gap - st.mean) / (st.n + 1) AS mean
            FROM st JOIN o ON o.model_id = st.model_id AND o.i = st.i + 1))))"""


@query(
    f"""WITH RECURSIVE {DAILY},
o AS (SELECT model_id, gap, day, row_number() OVER (PARTITION BY model_id ORDER BY day) - 1 AS i FROM daily), {_SIGMA}
SELECT model_id, i AS changepoint, strftime(day, '%Y-%m-%d') AS day FROM st JOIN o USING (model_id, i) WHERE hit"""
)
def running_sigma_changepoints(spark, folder):
    out = D.simple_changepoints(daily_gaps(spark, folder), _KEYS, "day", "gap")
    return out.select("model_id", "changepoint", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query(
    f"""WITH {DAILY}, s AS (SELECT model_id, regr_slope(gap, epoch(day) / 86400.0) AS slope FROM daily GROUP BY 1)
SELECT model_id, round(slope * 1000000, 4) AS slope_ppm,
  CASE WHEN slope > 0 THEN 'degrading' WHEN slope < 0 THEN 'improving' ELSE 'stable' END AS current_trend FROM s"""
)
def drift_trend(spark, folder):
    return D.trend(daily_gaps(spark, folder), _KEYS, "day", "gap").select(
        "model_id", F.round(F.col("slope") * 1000000, 4).alias("slope_ppm"), "current_trend"
    )


def _flat(out):
    return out.withColumns(
        {
            **{c: F.round(c, 6) for c in ("cusum", "current_mean", "historical_mean")},
            "slope": F.round("slope", 12),
            "drift_points": F.array_join(F.col("drift_points").cast("array<string>"), ","),
            "changepoints": F.array_join(F.col("changepoints").cast("array<string>"), ","),
        }
    )


def _history(spark, folder):
    return daily_gaps(spark, folder).select(
        "model_id",
        F.lit("demographic_parity_difference").alias("metric_name"),
        F.col("gap").alias("metric_value"),
        F.lit("PASS").alias("severity"),
        F.col("day").alias("recorded_at"),
    )


def _report_sql(kept="true"):
    """All statistics of the daily histories, each as its own query has it, joined."""
    steps, _ = _STEPS.format(goal="min(gap) OVER (PARTITION BY model_id)").split("\nSELECT")
    daily = DAILY.replace("daily AS (", "whole AS (") + f",\ndaily AS (SELECT * FROM whole WHERE {kept})"
    return f"""WITH RECURSIVE {daily}, {steps},
cu AS (SELECT model_id, points, greatest(max(cu - lu), max(cd - ld)) AS cusum FROM l GROUP BY 1, 2),
at_ AS (SELECT model_id, row_number() OVER w - 1 AS ln, count(*) OVER (PARTITION BY model_id) AS n, gap, sum(gap) OVER w - gap AS ls,
    sum(gap) OVER (PARTITION BY model_id) AS total FROM daily WINDOW w AS (PARTITION BY model_id ORDER BY day)),
ah AS (SELECT *, n >= 10 AND ln >= n // 4 AND ln < 3 * n // 4 AND ln >= 3 AND n - ln >= 3
    AND abs(ls / ln - (total - ls) / (n - ln)) >= sqrt(ln(4 / 0.002) / (2 / (1.0 / ln + 1.0 / (n - ln)))) AS hit FROM at_),
aw AS (SELECT model_id, bool_or(coalesce(hit, false)) AS drift_detected,
    coalesce(array_to_string((array_agg(ln ORDER BY ln) FILTER (hit))[1:5], ','), '') AS drift_points,
    avg(gap) FILTER (ln >= n - CAST(ceil(n / 4) AS BIGINT)) AS current_mean, avg(gap) FILTER (ln < n // 4) AS historical_mean FROM ah GROUP BY 1),
sl AS (SELECT model_id, regr_slope(gap, epoch(day) / 86400.0) AS slope FROM daily GROUP BY 1),
ser AS (SELECT model_id AS series, row_number() OVER (PARTITION BY model_id ORDER BY day) - 1 AS i, gap, strftime(day, '%Y-%m-%d %H:%M:%S') AS place FROM daily),
{_segments(1.0)},
cp AS (SELECT series, string_agg("at", ',' ORDER BY changepoint) AS changepoints FROM cuts GROUP BY 1),
o AS (SELECT series AS model_id, gap, i FROM ser), {_SIGMA},
js AS (SELECT model_id, count(*) FILTER (hit) AS jumps FROM st GROUP BY 1)
SELECT model_id, 'demographic_parity_difference' AS metric_name, points, round(cusum, 6) AS cusum, round(current_mean, 6) AS current_mean,
  round(historical_mean, 6) AS historical_mean, drift_detected, drift_points, round(slope, 12) AS slope,
  CASE WHEN slope > 0 THEN 'degrading' WHEN slope < 0 THEN 'improving' ELSE 'stable' END AS current_trend,
  coalesce(changepoints, '') AS changepoints, jumps
FROM cu JOIN aw USING (model_id) JOIN sl USING (model_id) JOIN js USING (model_id) LEFT JOIN cp ON series = model_id"""


@query(_report_sql())
def drift_report(spark, folder):
    return _flat(drift_statistics(_history(spark, folder)))


@query(_report_sql("model_id = 'model-o' AND day >= TIMESTAMP '2001-06-30' - INTERVAL 365 DAY"))
def drift_view(spark, folder):
    return _flat(view_of_model(_history(spark, folder), "model-o", "2001-06-30", days=365))
