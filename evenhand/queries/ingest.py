"""Ingest queries: parsing, validation, dead letters, enrichment, the audit scan."""

from pyspark.sql import functions as F

from evenhand.operators.cube import latest_demographics
from evenhand.operators.enrich import enrich, proxy_enrich
from evenhand.operators.validate import dead_letters, flatten_valid, validate
from evenhand.plans.audit import label_columns, scan_window, sensitive_columns
from evenhand.queries import query
from evenhand.queries.views import P, predictions
from evenhand.session import materialize
from evenhand.sources.events import split_bodies
from evenhand.sources.tables import load

# The events table as JSON messages, some of them broken. Same text both sides.
_SCORE = "'0.' || lpad(CAST((event_id * 37) % 100 AS varchar(20)), 2, '0')"
_RAW_BODY = """
  '{{"event_id":"e' || CAST(event_id AS varchar(20)) || '","model_id":"m-' ||
  CASE WHEN event_id % 7 = 1 THEN 'a b' ELSE event_type END ||
  '","model_version":"v1","timestamp":"' || {time} ||
  '","features":{{"sex":"' || CASE event_id % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN ' F '
     WHEN 3 THEN 'x' ELSE 'Male' END || '","age":' || CAST(user_id % 110 AS varchar(20)) ||
  ',"ethnicity":"' || CASE event_id % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'asian' WHEN 2 THEN 'n/a' ELSE 'hispanic' END ||
  '","zip":" ' || CAST(10000 + user_id AS varchar(20)) || ' ","k":' || regexp_replace(props, '[^0-9]', ''{all}) ||
  '}},"prediction":{{"label":' || CASE WHEN event_id % 11 = 3 THEN '1' ELSE '"' || CAST(event_id % 2 AS varchar(20)) || '"' END ||
  ',"score":' || CASE WHEN event_id % 7 = 2 THEN '1.5' ELSE {score} END || ',"threshold":0.5}},' ||
  CASE WHEN event_id % 3 = 0 THEN '' ELSE '"ground_truth":"' || CAST(event_id % 2 AS varchar(20)) || '",' END ||
  '"session_context":{{' || CASE WHEN event_id % 7 = 3 THEN '' ELSE '"tenant_id":"t1",' END ||
  '"use_case":"' || CASE WHEN event_id % 7 = 4 THEN 'weather' ELSE 'lending' END ||
  CASE WHEN event_id % 7 = 5 THEN '"' ELSE '"}}}}' END"""
_SPARK_RAW = _RAW_BODY.format(
    time="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", score=_SCORE, all=""
)
_DUCK_RAW = _RAW_BODY.format(time="strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", score=_SCORE, all=", 'g'")
_MESSAGES = f"msg AS (SELECT event_id AS n, {_DUCK_RAW} AS raw FROM events)"

_JUDGED = f"""{_MESSAGES},
j AS (SELECT *, json_valid(raw) AS ok FROM msg),
fields AS (SELECT n, raw, ok, CASE WHEN ok THEN raw ELSE '{{}}' END AS doc FROM j),
judged AS (SELECT *, CASE WHEN NOT ok THEN 'json: cannot be parsed' ELSE concat_ws('; ',
    CASE WHEN json_type(doc, '$.prediction.label') <> 'VARCHAR' THEN 'prediction.label: not a string' END,
    CASE WHEN json_extract_string(doc, '$.session_context.tenant_id') IS NULL THEN 'session_context.tenant_id: required' END,
    CASE WHEN contains(json_extract_string(doc, '$.model_id'), ' ') THEN 'model_id: contains a space' END,
    CASE WHEN CAST(json_extract_string(doc, '$.prediction.score') AS DOUBLE) NOT BETWEEN 0 AND 1
         THEN 'prediction.score: outside 0..1' END,
    CASE WHEN json_extract_string(doc, '$.session_context.use_case') NOT IN
      ('hiring', 'lending', 'healthcare', 'criminal_justice', 'content_recommendation')
      THEN 'session_context.use_case: unknown' END) END AS message FROM fields)"""

_VALID = f"""{_JUDGED},
v AS (SELECT json_extract_string(doc, '$.event_id') AS event_id, json_extract_string(doc, '$.model_id') AS model_id,
  json_extract_string(doc, '$.timestamp') AS t, json_extract(doc, '$.features') AS features,
  json_extract_string(doc, '$.prediction.label') AS prediction_label,
  CAST(json_extract_string(doc, '$.prediction.score') AS DOUBLE) AS prediction_score,
  json_extract_string(doc, '$.ground_truth') AS ground_truth,
  json_extract_string(doc, '$.session_context.use_case') AS use_case
  FROM judged WHERE message = '')"""


def messages(spark, folder):
    return load(spark, folder, "events").select(
        F.col("event_id").alias("n"), F.expr(_SPARK_RAW).alias("raw"), "user_id"
    )


def _valid(spark, folder):
    return flatten_valid(validate(messages(spark, folder)))


@query(f"WITH {_JUDGED} SELECT n, message = '' AS valid, message FROM judged")
def validate_split(spark, folder):
    return validate(messages(spark, folder)).select("n", "valid", "message")


@query(
    f"""WITH {_VALID}
SELECT event_id, model_id, 'v1' AS model_version, t AS event_time, CAST(features AS VARCHAR) AS features,
  prediction_label, prediction_score, 0.5 AS prediction_threshold, ground_truth, 't1' AS tenant_id, use_case FROM v"""
)
def flatten_events(spark, folder):
    return _valid(spark, folder).select(
        "event_id",
        "model_id",
        "model_version",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"),
        "features",
        "prediction_label",
        "prediction_score",
        "prediction_threshold",
        "ground_truth",
        "tenant_id",
        "use_case",
    )


@query(
    f"""WITH {_VALID} SELECT event_id, substr(t, 1, 10) AS day, CAST(prediction_label AS INTEGER) AS prediction_label,
  CAST(ground_truth AS INTEGER) AS ground_truth FROM v"""
)
def staged_predictions(spark, folder):
    from evenhand.plans.views import staged_predictions as staged

    return staged(_valid(spark, folder)).select(
        "event_id", F.col("day").cast("string").alias("day"), "prediction_label", "ground_truth"
    )


@query(
    f"""WITH {_JUDGED} SELECT raw AS original_message,
  CASE WHEN ok THEN 'ValidationError' ELSE 'JSONDecodeError' END AS error_type, message AS error_message
FROM judged WHERE message <> ''"""
)
def dead_letter(spark, folder):
    return dead_letters(validate(messages(spark, folder))).drop("failed_at")


@query(
    f"""WITH {_MESSAGES},
b AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1)
SELECT user_id, c AS batch_size, c > 500 AS oversized, c AS events FROM b"""
)
def batch_bodies(spark, folder):
    whole = messages(spark, folder).withColumn(
        "raw", F.when(F.col("raw").endswith("}}"), F.col("raw")).otherwise(F.concat("raw", F.lit("}}")))
    )
    bodies = whole.groupBy("user_id").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("raw"), ","), F.lit("]")).alias("raw")
    )
    return (
        split_bodies(bodies)
        .groupBy("user_id", "batch_size", "oversized")
        .agg(F.count("raw").alias("events"))
    )


_ENRICHED = f"""{_VALID},
x AS (SELECT *, trim(json_extract_string(features, '$.sex')) AS sx,
        json_extract_string(features, '$.ethnicity') AS eth,
        CAST(json_extract_string(features, '$.age') AS INTEGER) AS age,
        trim(json_extract_string(features, '$.zip')) AS zip_code FROM v),
d AS (SELECT event_id, model_id, t,
  CASE WHEN sx IN ('M', 'male', 'Male', 'm', '0') THEN '{{"MALE":1.0}}'
       WHEN sx IN ('F', 'female', 'Female', 'f', '1') THEN '{{"FEMALE":1.0}}' END AS gender_distribution,
  CASE eth WHEN 'White' THEN '{{"WHITE":1.0}}' WHEN 'asian' THEN '{{"ASIAN_PACIFIC":1.0}}'
       WHEN 'hispanic' THEN '{{"HISPANIC":1.0}}' END AS race_distribution,
  CASE WHEN age < 18 THEN 'AGE_UNDER_18' WHEN age < 30 THEN 'AGE_18_30' WHEN age < 40 THEN 'AGE_30_40'
       WHEN age < 50 THEN 'AGE_40_50' WHEN age < 60 THEN 'AGE_50_60' WHEN age < 999 THEN 'AGE_60_PLUS' END AS age_bin,
  zip_code FROM x)"""


@query(
    f"""WITH {_ENRICHED} SELECT event_id, model_id, t AS event_time, gender_distribution, race_distribution, age_bin,
  CASE WHEN gender_distribution IS NOT NULL OR race_distribution IS NOT NULL OR age_bin IS NOT NULL THEN 1.0 END
    AS proxy_quality_score, false AS is_proxy, zip_code FROM d"""
)
def enrich_demographics(spark, folder):
    return enrich(_valid(spark, folder)).select(
        "event_id",
        "model_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"),
        "gender_distribution",
        "race_distribution",
        "age_bin",
        "proxy_quality_score",
        "is_proxy",
        "zip_code",
    )


@query(
    f"""WITH {_ENRICHED}
SELECT v.event_id, v.model_id, v.ground_truth, d.age_bin,
  CASE json_extract_string(v.features, '$.sex') WHEN 'M' THEN 'Male' WHEN 'female' THEN 'Female'
    ELSE json_extract_string(v.features, '$.sex') END AS sex,
  json_extract_string(v.features, '$.age') AS age,
  CAST(v.ground_truth AS INTEGER) AS y_true, CAST(v.prediction_label AS INTEGER) AS y_pred, v.prediction_score AS y_score
FROM v LEFT JOIN d ON v.event_id = d.event_id
WHERE v.ground_truth IS NOT NULL AND v.t >= '2024-01-05T00:00:00Z' AND v.t < '2024-01-20T00:00:00Z'"""
)
def audit_scan_join(spark, folder):
    # the ingested table, as the audit finds it
    rows = materialize(_valid(spark, folder), "valid-rows")
    window = scan_window(rows, enrich(rows), start="2024-01-05", end="2024-01-20")
    return label_columns(sensitive_columns(window)).select(
        "event_id", "model_id", "ground_truth", "age_bin", "sex", "age", "y_true", "y_pred", "y_score"
    )


_SIDE_ROWS = """side AS (
  SELECT event_id, 'AGE_' || CAST(line_no AS VARCHAR) AS age_bin, 1 AS version FROM p WHERE line_no % 2 = 1
  UNION ALL SELECT event_id, 'AGE_X', 2 FROM p WHERE line_no = 3)"""


def _side_rows(rows):
    odd = rows.where("line_no % 2 = 1").select(
        "event_id", F.concat(F.lit("AGE_"), "line_no").alias("age_bin"), F.lit(1).alias("enriched_at")
    )
    again = rows.where("line_no = 3").select(
        "event_id", F.lit("AGE_X").alias("age_bin"), F.lit(2).alias("enriched_at")
    )
    return odd.unionByName(again)


@query(
    f"""WITH {P}, {_SIDE_ROWS}
SELECT model_id, coalesce(age_bin, 'None') AS age_bin, count(*) AS n
FROM p LEFT JOIN side USING (event_id) GROUP BY ALL"""
)
def demographics_fan_out(spark, folder):
    rows = predictions(spark, folder)
    return (
        rows.join(_side_rows(rows).drop("enriched_at"), "event_id", "left")
        .groupBy("model_id", F.coalesce("age_bin", F.lit("None")).alias("age_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    f"""WITH {P}, {_SIDE_ROWS}, one AS (
  SELECT event_id, arg_max(age_bin, version) AS age_bin FROM side GROUP BY 1)
SELECT model_id, coalesce(age_bin, 'None') AS age_bin, count(*) AS n
FROM p LEFT JOIN one USING (event_id) GROUP BY ALL"""
)
def demographics_latest(spark, folder):
    rows = predictions(spark, folder)
    side = latest_demographics(_side_rows(rows)).drop("enriched_at")
    return (
        rows.join(side, "event_id", "left")
        .groupBy("model_id", F.coalesce("age_bin", F.lit("None")).alias("age_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Lookup tables for proxies, derived from the supplied tables: part of a
# customer's name stands for a first name, the nation for a surname and ZIP code.
_LOOKUPS = """
names AS (SELECT DISTINCT CAST(c_custkey % 9 AS VARCHAR) AS first_name, code,
   CASE code WHEN 'MALE' THEN (c_custkey % 9 + 1) / 10 ELSE 1 - (c_custkey % 9 + 1) / 10 END AS weight
   FROM customer, (VALUES ('MALE'), ('FEMALE')) c(code)),
surnames AS (SELECT n_name AS surname, code, (n_nationkey % 4 + w) / 10 AS weight
   FROM nation, (VALUES ('WHITE', 1), ('BLACK', 3)) c(code, w)),
places AS (SELECT 'z' || n_regionkey AS zip_code, code, max(n_nationkey % 3 + w) / 20 AS weight
   FROM nation, (VALUES ('WHITE', 2), ('BLACK', 1)) c(code, w) GROUP BY 1, 2),
people AS (SELECT 'c' || c_custkey AS event_id, CAST(c_custkey % 12 AS VARCHAR) AS first_name, n_name AS surname,
   'z' || n_regionkey AS zip_code FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    f"""WITH {_LOOKUPS},
gender AS (SELECT event_id, max(weight) / sum(weight) AS q,
    round(sum(weight) FILTER (code = 'MALE') / sum(weight), 6) AS male_share
  FROM people JOIN names USING (first_name) GROUP BY 1),
race AS (SELECT event_id, max(s.weight * l.weight) / sum(s.weight * l.weight) AS q,
    round(sum(s.weight * l.weight) FILTER (code = 'WHITE') / sum(s.weight * l.weight), 6) AS white_share
  FROM people JOIN surnames s USING (surname) JOIN places l USING (zip_code, code) GROUP BY 1)
SELECT event_id, male_share, white_share, 'B_' || zip_code AS income_bracket,
  round(CASE WHEN gender.q IS NULL THEN race.q ELSE (gender.q + race.q) / 2 END, 6) AS proxy_quality_score,
  true AS is_proxy
FROM people LEFT JOIN gender USING (event_id) LEFT JOIN race USING (event_id)"""
)
def proxy_demographics(spark, folder):
    customer, nation = load(spark, folder, "customer"), load(spark, folder, "nation")

    def coded(df, *pairs):
        entries = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(w).alias("w")) for c, w in pairs])
        return df.select("*", F.inline(entries))

    part = F.col("c_custkey") % 9
    share = (part + 1) / 10
    names = (
        coded(customer, ("MALE", 0), ("FEMALE", 0))
        .select(
            part.cast("string").alias("first_name"),
            "code",
            F.when(F.col("code") == "MALE", share).otherwise(1 - share).alias("weight"),
        )
        .distinct()
    )
    surnames = coded(nation, ("WHITE", 1), ("BLACK", 3)).select(
        F.col("n_name").alias("surname"),
        "code",
        ((F.col("n_nationkey") % 4 + F.col("w")) / 10).alias("weight"),
    )
    zip_code = F.concat(F.lit("z"), "n_regionkey")
    places = (
        coded(nation, ("WHITE", 2), ("BLACK", 1))
        .groupBy(zip_code.alias("zip_code"), "code")
        .agg((F.max(F.col("n_nationkey") % 3 + F.col("w")) / 20).alias("weight"))
    )
    brackets = nation.select(
        zip_code.alias("zip_code"), F.concat(F.lit("B_z"), "n_regionkey").alias("income_bracket")
    ).distinct()
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("c"), "c_custkey").alias("event_id"),
        (F.col("c_custkey") % 12).cast("string").alias("first_name"),
        F.col("n_name").alias("surname"),
        zip_code.alias("zip_code"),
    )
    return proxy_enrich(people, names, surnames, places, brackets).select(
        "event_id",
        F.get_json_object("gender_distribution", "$.MALE").cast("double").alias("male_share"),
        F.get_json_object("race_distribution", "$.WHITE").cast("double").alias("white_share"),
        "income_bracket",
        F.round("proxy_quality_score", 6).alias("proxy_quality_score"),
        "is_proxy",
    )
