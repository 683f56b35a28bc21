"""Personal data in text: tokens, masks and findings, all in built-in functions."""

from pyspark.sql import DataFrame, functions as F

# What counts as personal data.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
CARD = r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"
PASSPORT = r"\b[A-Z][0-9]{8}\b"
STREET = (
    r"\b[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b"
)
REST_SCAN_TYPES = {
    "EMAIL_ADDRESS": EMAIL,
    "PHONE_NUMBER": PHONE,
    "CREDIT_CARD_NUMBER": CARD,
    "PASSPORT": PASSPORT,
    "STREET_ADDRESS": STREET,
}
NUMBER_PATTERN = "|".join((SSN, PHONE))
TOKEN_PATTERN = "|".join((EMAIL, NUMBER_PATTERN))

# A JSON string literal, with the colon if it is a key, once escaped backslashes
# and quotes are out of the way. Control characters cannot occur in JSON text,
# so they can stand in for the escapes.
_JSON_TEXT = r'"[^"]*"(?:\s*:)?'
_ESCAPES = (("\\\\", "\x01"), ('\\"', "\x02"))


def replace_matches(text, pattern: str, replacement) -> F.Column:
    """Replace each match by ``replacement(match)``, by position.

    The pieces between matches and the matches come from the same pattern and
    are put back together alternately."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(pieces, F.transform(matches, replacement), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))),
        "",
    )


def token(match, key: str) -> F.Column:
    """Keyed digest of a value: equal values give equal tokens."""
    return F.concat(
        F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(f"{key}:"), match), 256), 1, 24)
    )


def tokenise(text, key: str) -> F.Column:
    """Text with e-mail addresses, phone and social security numbers as tokens."""
    text = F.col(text) if isinstance(text, str) else text

    def replaced(pattern):
        return replace_matches(text, pattern, lambda m: token(m, key))

    # most texts hold no address, and only an address needs the slow pattern
    return F.when(text.contains("@"), replaced(TOKEN_PATTERN)).otherwise(replaced(NUMBER_PATTERN))


def matches(text: str, pattern: str) -> F.Column:
    """All matches in a text column."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    if pattern != EMAIL:
        return found
    return F.when(F.col(text).contains("@"), found).otherwise(F.array().cast("array<string>"))


def mask(text, pattern: str = SSN) -> F.Column:
    """Text with each match overwritten by as many ``*``."""
    return replace_matches(text, pattern, lambda m: F.repeat(F.lit("*"), F.length(m)))


def tokenise_features(features, key: str) -> F.Column:
    """JSON text with personal data in its string values as tokens.

    Works at any depth and leaves object keys and numbers alone. Strings inside
    lists are covered too. Values are decoded before matching, so an escape is
    never taken for a letter."""
    text = F.col(features) if isinstance(features, str) else features
    for escape, stand_in in _ESCAPES:
        text = F.replace(text, F.lit(escape), F.lit(stand_in))

    def restored(literal):
        for escape, stand_in in _ESCAPES[::-1]:
            literal = F.replace(literal, F.lit(stand_in), F.lit(escape))
        return literal

    def redacted(literal):
        raw = restored(literal)
        decoded = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]
        encoded = F.to_json(F.array(tokenise(decoded, key)))
        plain = raw.endswith(":") | ~raw.rlike("[@0-9]")
        return F.when(plain, raw).otherwise(F.substr(encoded, F.lit(2), F.length(encoded) - 2))

    return replace_matches(text, _JSON_TEXT, redacted)


def redact_predictions(predictions: DataFrame, key: str) -> DataFrame:
    return predictions.withColumn("features", tokenise_features("features", key))


def luhn_valid(number) -> F.Column:
    """Checksum of a card number given as text with optional separators."""
    digits = F.transform(
        F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def scan_text(rows: DataFrame, ids, text: str, types: dict | None = None) -> DataFrame:
    """Findings: one row per match with its type, position number and quote."""
    types = types or REST_SCAN_TYPES
    found = F.array(
        *[
            F.struct(
                F.lit(name).alias("info_type"),
                matches(text, pattern).alias("quotes"),
            )
            for name, pattern in types.items()
        ]
    )
    return (
        rows.select(*ids, F.inline(found))
        .select(*ids, "info_type", F.posexplode("quotes").alias("match_no", "quote"))
        .withColumn(
            "checksum_ok",
            F.when(F.col("info_type") == "CREDIT_CARD_NUMBER", luhn_valid(F.col("quote"))),
        )
    )


def scan_summary(rows: DataFrame, text_columns, day=None, types: dict | None = None) -> DataFrame:
    """Findings counted by type, column and day. Each text is read once and only
    its counts are shuffled."""
    types = types or REST_SCAN_TYPES
    found = F.array(
        *[
            F.struct(
                F.lit(name).alias("info_type"),
                F.lit(c).alias("column_name"),
                F.size(matches(c, pattern)).alias("hits"),
            )
            for c in text_columns
            for name, pattern in types.items()
        ]
    )
    day = F.lit(None).cast("date") if day is None else day
    return (
        rows.select(day.alias("day"), F.inline(found))
        .where("hits > 0")
        .groupBy("info_type", "column_name", "day")
        .agg(F.sum("hits").alias("findings"), F.count(F.lit(1)).alias("rows"))
    )
