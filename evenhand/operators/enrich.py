"""Demographic enrichment of prediction rows from their features."""

from pyspark.sql import DataFrame, functions as F

from evenhand.schemas import (
    AGE_BINS,
    AGE_KEYS,
    GENDER_CODES,
    GENDER_KEYS,
    RACE_CODES,
    RACE_KEYS,
    ZIP_KEYS,
)


def literal_map(mapping: dict) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def strip(column) -> F.Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def age_bin(column) -> F.Column:
    """Age group of a number or of text holding one; null outside the bins."""
    value = F.col(column) if isinstance(column, str) else column
    years = value.try_cast("double").try_cast("int")
    out = None
    for low, high, label in AGE_BINS:
        inside = (years >= low) & (years < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def gender_code(column) -> F.Column:
    return literal_map(GENDER_CODES)[strip(column)]


def race_code(column) -> F.Column:
    return literal_map(RACE_CODES)[strip(column)]


def first_mapped(entries, keys, mapping) -> F.Column:
    """First entry, in document order, under one of ``keys`` that maps to a value."""
    named = F.filter(entries, lambda e: e["key"].isin(*keys))
    mapped = F.filter(F.transform(named, lambda e: mapping(e["value"])), lambda v: v.isNotNull())
    return F.get(mapped, F.lit(0))


def one_hot(code) -> F.Column:
    """A certain value as a distribution, in JSON."""
    return F.when(code.isNotNull(), F.concat(F.lit('{"'), code, F.lit('":1.0}')))


def enrich(predictions: DataFrame, enriched_at=None) -> DataFrame:
    """Rows of the demographics table, one per prediction; direct labels only."""
    entries = F.coalesce(
        F.map_entries(F.from_json("features", "map<string,string>")),
        F.array().cast("array<struct<key:string,value:string>>"),
    )
    found = predictions.withColumn("_entries", entries).select(
        "event_id",
        "model_id",
        "timestamp",
        first_mapped(F.col("_entries"), GENDER_KEYS, gender_code).alias("gender"),
        first_mapped(F.col("_entries"), RACE_KEYS, race_code).alias("race"),
        first_mapped(F.col("_entries"), AGE_KEYS, age_bin).alias("age_bin"),
        first_mapped(F.col("_entries"), ZIP_KEYS, strip).alias("zip_code"),
    )
    known = F.coalesce("gender", "race", "age_bin").isNotNull()
    return found.select(
        "event_id",
        "model_id",
        "timestamp",
        one_hot(F.col("gender")).alias("gender_distribution"),
        one_hot(F.col("race")).alias("race_distribution"),
        "age_bin",
        F.lit(None).cast("string").alias("income_bracket"),
        F.when(known, F.lit(1.0)).alias("proxy_quality_score"),
        F.lit(False).alias("is_proxy"),
        "zip_code",
        (enriched_at if enriched_at is not None else F.current_timestamp()).alias("enriched_at"),
    )


def folded(lookup: DataFrame, key: F.Column, name: str) -> DataFrame:
    """One row for each key of a lookup with code and weight: ``_k`` and the map ``name``
    from code to weight. Weights of a code that comes more than once add up."""
    once = lookup.groupBy(key.alias("_k"), "code").agg(F.sum("weight").alias("weight"))
    # as many entries as the lookup's vocabulary has codes, a handful
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "weight"))))
    return once.groupBy("_k").agg(entries.alias(name))


def _distribution(weights: F.Column, name: str) -> list[F.Column]:
    """The normalised distribution of a map of weights and its quality, the share of the
    likeliest code; both null without weight."""
    values = F.map_values(weights)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return [
        F.when(total > 0, F.transform_values(weights, lambda _, v: F.round(v / total, 6))).alias(name),
        F.when(total > 0, F.array_max(values) / total).alias(f"{name}_quality"),
    ]


def _looked_up(rows: DataFrame, lookup: DataFrame, key: F.Column) -> DataFrame:
    return rows.withColumn("_k", key).join(lookup, "_k", "left").drop("_k")


def proxy_gender(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Gender distribution by first name. ``names`` has first_name, code, weight.

    Adds ``gender_distribution`` and ``gender_distribution_quality``."""
    key = F.lower(strip("first_name"))
    found = _looked_up(rows, folded(names, key, "_gender"), key)
    return found.select("*", *_distribution(F.col("_gender"), "gender_distribution")).drop("_gender")


def proxy_race(rows: DataFrame, surnames: DataFrame, places: DataFrame) -> DataFrame:
    """Race distribution from surname and ZIP code by Bayes' rule.

    ``surnames`` has surname, code, weight = P(code | surname); ``places`` has
    zip_code, code, weight = P(zip | code). The product, normalised per row, is
    the posterior. Adds ``race_distribution`` and ``race_distribution_quality``."""
    name = F.upper(strip("surname"))
    found = _looked_up(rows, folded(surnames, name, "_prior"), name)
    found = _looked_up(found, folded(places, F.col("zip_code"), "_likelihood"), F.col("zip_code"))
    joint = F.map_filter(
        F.map_zip_with("_prior", "_likelihood", lambda _, a, b: a * b), lambda _, v: v.isNotNull()
    )
    found = found.withColumn("_joint", joint)
    return found.select("*", *_distribution(F.col("_joint"), "race_distribution")).drop(
        "_prior", "_likelihood", "_joint"
    )


def proxy_income(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Adds the income bracket by ZIP code. ``brackets`` has zip_code and income_bracket."""
    once = brackets.groupBy("zip_code").agg(F.min("income_bracket").alias("income_bracket"))
    return rows.join(once, "zip_code", "left")


def proxy_enrich(
    rows: DataFrame,
    names: DataFrame,
    surnames: DataFrame,
    places: DataFrame,
    brackets: DataFrame,
    row_id: str = "event_id",
) -> DataFrame:
    """Proxy demographics per row: distributions only, marked and scored.

    The lookup tables come from the user; each is folded to one row for each key, and how
    they are joined is left to their size at run time. Rows are read once and never
    regrouped, so an id that comes more than once is enriched as often."""
    rows = rows.select(row_id, "first_name", "surname", "zip_code")
    out = proxy_income(proxy_race(proxy_gender(rows, names), surnames, places), brackets)
    scores = F.array_compact(
        F.array("gender_distribution_quality", "race_distribution_quality")
    )
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    return out.select(
        row_id,
        F.to_json("gender_distribution").alias("gender_distribution"),
        F.to_json("race_distribution").alias("race_distribution"),
        "income_bracket",
        mean.alias("proxy_quality_score"),
        F.lit(True).alias("is_proxy"),
    )
