"""Personal-data queries over documents and conversations, whole texts."""

from pyspark.sql import functions as F

from evenhand.operators import privacy as R
from evenhand.queries import query
from evenhand.sources.tables import load

_KEY = "bench-key"


def _lit(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _hits(table, column):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS info_type, '{column}' AS column_name, "
        f"len(regexp_extract_all({column}, {_lit(p)})) AS hits FROM {table}"
        for name, p in R.REST_SCAN_TYPES.items()
    )


def _replaced(text, pattern, replacement):
    """Rebuild a text from the pieces between matches and the replaced matches."""
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, {_lit(pattern)}), "
        f"list_transform(regexp_extract_all({text}, {_lit(pattern)}), lambda m: {replacement})), "
        "lambda z: z[1] || coalesce(z[2], '')), '')"
    )


_TOKEN = f"'tok_' || substr(sha256('{_KEY}:' || m), 1, 24)"


@query(
    f"""SELECT info_type, column_name, CAST(sum(hits) AS BIGINT) AS findings, count(*) AS rows
FROM ({_hits('documents', 'text')}) WHERE hits > 0 GROUP BY ALL"""
)
def pii_scan_documents(spark, folder):
    return R.scan_summary(load(spark, folder, "documents"), ["text"]).drop("day")


@query(
    f"""SELECT info_type, column_name, CAST(sum(hits) AS BIGINT) AS findings, count(*) AS rows
FROM ({_hits('conversations', 'text')}) WHERE hits > 0 GROUP BY ALL"""
)
def pii_scan_conversations(spark, folder):
    return R.scan_summary(load(spark, folder, "conversations"), ["text"]).drop("day")


@query(
    f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(R.CARD)})) AS quote FROM documents),
n AS (SELECT doc_id, quote, reverse(regexp_replace(quote, '[^0-9]', '', 'g')) AS digits FROM f),
s AS (SELECT doc_id, quote, list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(substr(digits, i, 1) AS INTEGER)
         WHEN CAST(substr(digits, i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(digits, i, 1) AS INTEGER) * 2 - 9
         ELSE CAST(substr(digits, i, 1) AS INTEGER) * 2 END)) % 10 = 0 AS checksum_ok FROM n)
SELECT doc_id, quote, checksum_ok, count(*) AS times FROM s GROUP BY ALL"""
)
def pii_card_findings(spark, folder):
    found = R.scan_text(
        load(spark, folder, "documents"), ["doc_id"], "text", {"CREDIT_CARD_NUMBER": R.CARD}
    )
    return found.groupBy("doc_id", "quote", "checksum_ok").agg(F.count(F.lit(1)).alias("times"))


@query(f"SELECT doc_id, md5({_replaced('text', R.TOKEN_PATTERN, _TOKEN)}) AS digest FROM documents")
def pii_tokenise(spark, folder):
    return load(spark, folder, "documents").select(
        "doc_id", F.md5(R.tokenise("text", _KEY)).alias("digest")
    )


_MASK = "repeat('*', length(m))"


@query(f"SELECT doc_id, md5({_replaced('text', R.PHONE, _MASK)}) AS digest FROM documents")
def pii_mask(spark, folder):
    return load(spark, folder, "documents").select(
        "doc_id", F.md5(R.mask("text", R.PHONE)).alias("digest")
    )


# Features with personal data one level down; the values hold quotes and breaks.


@query(
    f"""SELECT doc_id, md5({_replaced('text', R.TOKEN_PATTERN, _TOKEN)}) AS body_digest, lang AS name, n_chars AS n
FROM documents"""
)
def pii_tokenise_features(spark, folder):
    nested = F.to_json(
        F.struct(
            F.col("lang").alias("name"),
            F.struct(F.col("text").alias("body")).alias("note"),
            F.col("n_chars").alias("n"),
        )
    )
    redacted = load(spark, folder, "documents").select(
        "doc_id", R.tokenise_features(nested, _KEY).alias("features")
    )
    parsed = F.from_json("features", "name string, note struct<body string>, n long")
    return redacted.withColumn("f", parsed).select(
        "doc_id", F.md5("f.note.body").alias("body_digest"), "f.name", "f.n"
    )
