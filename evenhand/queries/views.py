"""Prediction data seen through the supplied tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.sources.tables import load

ATTRIBUTES = ("sex", "segment")
KEYS = ("model_id",)

# the group columns are made up for testing and say nothing about people
PREDICTIONS_SQL = """
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS event_id,
       concat('model-', lower(l_linestatus)) AS model_id,
       CAST(l_shipdate AS timestamp) AS ts,
       c_mktsegment AS segment,
       CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
       (l_quantity - 0.5) / 50 AS y_score,
       CASE WHEN (l_quantity - 0.5) / 50 >=
            CASE WHEN l_linestatus = 'O' AND c_custkey % 2 = 1 THEN 0.75 ELSE 0.5 END
            THEN 1 ELSE 0 END AS y_pred,
       CASE WHEN l_quantity + 400 * (l_tax - 0.04) >= 25.5 THEN 1 ELSE 0 END AS y_true,
       concat('v', l_linenumber) AS model_version,
       l_linenumber AS line_no,
       l_extendedprice AS price,
       l_discount AS discount,
       l_tax AS tax,
       l_quantity AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""


def predictions(spark: SparkSession, folder: str, line: DataFrame | None = None) -> DataFrame:
    """The line items (or a stream of them) as scored events of two models."""
    orders, customer = (load(spark, folder, t) for t in ("orders", "customer"))
    line = load(spark, folder, "lineitem") if line is None else line
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    score = (F.col("l_quantity") - 0.5) / 50
    odd = F.col("c_custkey") % 2 == 1
    cut = F.when((F.col("l_linestatus") == "O") & odd, 0.75).otherwise(0.5)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("event_id"),
        F.concat(F.lit("model-"), F.lower("l_linestatus")).alias("model_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("c_mktsegment").alias("segment"),
        F.when(odd, "Female").otherwise("Male").alias("sex"),
        score.alias("y_score"),
        (score >= cut).cast("int").alias("y_pred"),
        (F.col("l_quantity") + 400 * (F.col("l_tax") - 0.04) >= 25.5).cast("int").alias("y_true"),
        F.concat(F.lit("v"), "l_linenumber").alias("model_version"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
    )


# Shared SQL for the checks: predictions, rows per attribute, the group cube,
# and the totals and privileged group per model and attribute.
P = f"p AS ({PREDICTIONS_SQL})"
LONG = (
    P
    + """,
long AS (
  SELECT model_id, 'sex' AS attribute, 0 AS attribute_ord, sex AS group_value,
         event_id, ts, y_score, y_pred, y_true, segment AS other FROM p
  UNION ALL
  SELECT model_id, 'segment', 1, segment, event_id, ts, y_score, y_pred, y_true, sex FROM p)"""
)
GROUPS = (
    LONG
    + """,
g AS (
  SELECT model_id, attribute, attribute_ord, group_value,
         CAST(count(*) AS BIGINT) AS n,
         CAST(sum(y_pred) AS BIGINT) AS pred_pos,
         CAST(sum(y_true) AS BIGINT) AS true_pos,
         CAST(sum(y_pred * y_true) AS BIGINT) AS tp,
         CAST(sum(y_pred * (1 - y_true)) AS BIGINT) AS fp,
         CAST(sum((1 - y_pred) * (1 - y_true)) AS BIGINT) AS tn,
         CAST(sum((1 - y_pred) * y_true) AS BIGINT) AS fn
  FROM long GROUP BY ALL)"""
)
FRAME = (
    GROUPS
    + """,
f AS (
  SELECT model_id, attribute, attribute_ord,
         CAST(sum(n) AS BIGINT) AS sample_size,
         CAST(sum(pred_pos) AS BIGINT) AS sample_pos,
         count(*) AS group_count,
         CASE WHEN attribute = 'sex' THEN 'Male'
              ELSE arg_min(group_value, (-n, group_value)) END AS privileged_group
  FROM g GROUP BY model_id, attribute, attribute_ord),
s AS (
  SELECT g.*, sample_size, sample_pos, group_count, privileged_group,
         CASE WHEN group_value = privileged_group THEN 1 ELSE 0 END AS pr
  FROM g JOIN f USING (model_id, attribute, attribute_ord))"""
)


def quarter_start(at) -> F.Column:
    """First month of a time's quarter as year-month; a date's own text needs no formatter."""
    day = F.trunc(at, "quarter").cast("string")
    return F.left(day, F.length(day) - 3)


def by_quarter(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with the first month of the quarter they fall in."""
    return predictions(spark, folder).withColumn("month", quarter_start("ts"))


# The same rows with the quarter inside the key, so that one SQL audits models and quarters.
QUARTERLY = PREDICTIONS_SQL.replace(
    "concat('model-', lower(l_linestatus)) AS model_id",
    "concat('model-', lower(l_linestatus), '~', strftime(date_trunc('quarter', l_shipdate), '%Y-%m')) AS model_id",
)
