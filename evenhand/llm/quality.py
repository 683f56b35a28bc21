"""Quality rules with thresholds learnt from the corpus, per language and source.

Every document is measured once. The measures of the documents that pass the base
rules are summed into quantile sketches: counts per bucket of a log-linear grid
(relative error at most 1/32), so that two sketches merge by adding counts. The limit of
a rule is where the 200-quantiles of a (language, source) sketch break away from its bulk:
the first place above the median at which they rise by more than ``rise`` within one
hundredth of the documents, and the limit lies in the middle of that rise (for low limits,
downward from the median). Where there is no such place the rule rejects nothing. A group
with too few documents takes the merged sketch of its language, then that of the corpus.
The limits are joined back to the measures, and a document over any limit is rejected.

Everything is built-in DataFrame functions and integer arithmetic: a rerun gives the
same rows. Nulls: a null text has no words; null languages and sources are groups
like any other. Repeated rows are judged one by one. An empty table gives no rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import GAP, WORD, let, sized
from evenhand.session import materialize

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A measure that may not lie above (``low``: below) the place where its quantiles rise
    by more than ``rise`` within one hundredth of the documents."""

    name: str
    value: Column
    rise: int
    low: bool = False


def _per_mille(part: str, whole: str) -> Column:
    return F.expr(f"CAST(1000 * {part} DIV greatest({whole}, 1) AS BIGINT)")


def rules() -> list[Rule]:
    """The default rules, over the columns of :func:`measure`."""
    length = F.expr("CAST(100 * word_chars DIV greatest(n_words, 1) AS BIGINT)")
    return [
        Rule("symbols", _per_mille("n_symbols", "word_chars"), 40),
        Rule("marks", _per_mille("n_marks", "word_chars"), 80),
        Rule("capitals", _per_mille("n_capitals", "word_chars"), 150),
        Rule("echoes", _per_mille("n_echoes", "n_words"), 200),
        Rule("dup_lines", _per_mille("n_dup_lines", "n_lines"), 600),
        Rule("repeats", _per_mille("n_repeat_words", "n_words"), 280),
        Rule("long_words", length, 300),
        Rule("short_words", length, 200, low=True),
    ]


def repeat_words(words: Column) -> Column:
    """Words covered by windows of eight words that occur twice or more among ``words``.

    Hashes only find the texts without any repeated window; the others are settled on
    the words themselves."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    keyed = F.array_sort(
        F.transform(
            starts,
            lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )

    def covered(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k)["w"] == F.get(s, k + d)["w"], F.lit(False))
        at = F.sequence(F.lit(0), F.size(s) - 1)
        repeated = F.filter(at, lambda k: same(k, -1) | same(k, 1))
        order = F.array_sort(F.transform(repeated, lambda k: F.get(s, k)["i"]))
        return F.aggregate(
            order,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )

    found = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(keyed, covered)
        ),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found)


def measure(text: Column) -> Column:
    """Struct of the counts the rules are made of, from one split of the whole text."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, GAP), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    count = lambda p: F.regexp_count(whole, F.lit(p)).cast("long")
    return let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            repeat_words(s["w"]).cast("long").alias("n_repeat_words"),
            F.size(F.filter(s["w"], lambda w, i: w == F.get(s["w"], i - 1)))
            .cast("long")
            .alias("n_echoes"),
            F.size(s["l"]).cast("long").alias("n_lines"),
            count(r"[!-/:-@\[-`{-~]").alias("n_marks"),
            count("[A-Z]").alias("n_capitals"),
        ),
    )


def bucket(v: Column) -> Column:
    """Cell of the log-linear grid: exact below 64, then 32 cells for each doubling."""
    return let(
        v,
        lambda x: F.when(x < 64, x).otherwise(
            let(
                F.length(F.bin(x)) - 6,
                lambda e: 64 + (e - 1) * 32 + F.call_function("shiftright", x, e) - 32,
            )
        ),
    ).cast("long")


def sketches(measured: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Counts per (lang, source, rule, bucket), with the largest value seen in each."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("v")) for k, v in values.items()])
    )
    return (
        measured.select("lang", "source", cells.alias("c"))
        .select("lang", "source", "c.rule", "c.v", bucket(F.col("c.v")).alias("bucket"))
        .groupBy("lang", "source", "rule", "bucket")
        .agg(F.count("*").alias("n"), F.max("v").alias("top"))
    )


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sum of sketches that agree on ``by``."""
    return sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


#: Quantiles of a sketch, and how many of them one rise may span: one hundredth of all.
STEPS, SPAN = 200, 2


def breaks(sketch: DataFrame, by: list[str], chosen: list[Rule]) -> DataFrame:
    """``docs``, ``high`` and ``low`` of each rule, per ``by``: the middles of the first rise
    above and below the median, null where there is none.

    Each cell of a sketch is spread over the quantiles that end in it, ``STEPS`` rows in all
    for each sketch, whatever its documents."""
    keys = ", ".join([*by, "rule"])
    rise = F.create_map(*[F.lit(x) for r in chosen for x in (r.name, r.rise)])
    cells = sketch.withColumns(
        {
            "upto": F.expr(f"sum(n) OVER (PARTITION BY {keys} ORDER BY bucket)"),
            "docs": F.expr(f"sum(n) OVER (PARTITION BY {keys})"),
        }
    )
    steps = cells.withColumns(
        {
            "first": F.expr(f"{STEPS} * (upto - n) DIV docs + 1"),
            "last": F.expr(f"{STEPS} * upto DIV docs"),
        }
    ).where("first <= last")
    steps = steps.withColumn("step", F.explode(F.expr("sequence(first, last)")))
    near = steps.withColumns(
        {
            "ahead": F.expr(
                f"max(top) OVER (PARTITION BY {keys} ORDER BY step ROWS BETWEEN CURRENT ROW AND {SPAN} FOLLOWING)"
            ),
            "behind": F.expr(
                f"min(top) OVER (PARTITION BY {keys} ORDER BY step ROWS BETWEEN {SPAN} PRECEDING AND CURRENT ROW)"
            ),
            "rise": rise[F.col("rule")],
        }
    )
    half = STEPS // 2
    return near.groupBy(*by, "rule").agg(
        F.max("docs").alias("docs"),
        F.expr(
            f"min_by((top + ahead) / 2, step) FILTER (WHERE step >= {half} AND ahead - top > rise)"
        ).alias("high"),
        F.expr(
            f"max_by((top + behind) / 2, step) FILTER (WHERE step <= {half} AND top - behind > rise)"
        ).alias("low"),
    )


def limits(sketch: DataFrame, chosen: list[Rule], min_docs: int) -> DataFrame:
    """One row per (lang, source) with an array of limits in the order of ``chosen``."""
    own = breaks(sketch, ["lang", "source"], chosen)
    lang = breaks(merged(sketch, ["lang"]), ["lang"], chosen)
    every = breaks(merged(sketch, []), [], chosen)
    o, g, e = own.alias("o"), lang.alias("g"), every.alias("e")
    joined = o.join(
        g, F.col("o.lang").eqNullSafe(F.col("g.lang")) & (F.col("o.rule") == F.col("g.rule"))
    ).join(e, F.col("o.rule") == F.col("e.rule"))
    pick = lambda k: F.expr(
        f"CASE WHEN o.docs >= {min_docs} THEN o.{k} WHEN g.docs >= {min_docs} THEN g.{k} ELSE e.{k} END"
    )
    parts = joined.select("o.lang", "o.source", "o.rule", pick("high").alias("high"), pick("low").alias("low"))
    at = lambda r: F.max(F.when(F.col("rule") == r.name, F.col("low" if r.low else "high")))
    return parts.groupBy("lang", "source").agg(F.array(*[at(r) for r in chosen]).alias("bounds"))


def judge(
    docs: DataFrame,
    carry: list[str],
    chosen: list[Rule] | None = None,
    min_docs: int = 200,
    min_words: int = 20,
    repeat_percent: int = 30,
) -> DataFrame:
    """``_row`` (the carried columns), the measures, ``base_failed``, ``broken`` and ``kept``.

    ``broken`` lists the adaptive rules a document breaks, in the order of ``chosen``.
    ``min_docs``: a group with fewer documents takes the merged sketch of its language,
    or that of the corpus."""
    chosen = chosen or rules()
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        measure(F.col("text")).alias("m"),
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")
    )
    measured = materialize(
        packed.select("_row", "lang", "source", "m.*").withColumn("base_failed", failed),
        "quality-measures",
    )
    values = {r.name: r.value for r in chosen}
    sketch = materialize(sketches(measured.where("NOT base_failed"), values), "quality-sketches")
    bounds = sized(limits(sketch, chosen, min_docs), "quality-limits").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), "bounds"
    )
    joined = measured.join(
        bounds,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    broken = F.filter(
        F.array(
            *[
                F.when(
                    (r.value < F.get("bounds", F.lit(i)))
                    if r.low
                    else (r.value > F.get("bounds", F.lit(i))),
                    F.lit(r.name),
                )
                for i, r in enumerate(chosen)
            ]
        ),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast("array<string>")
    return joined.withColumn(
        "broken", F.when(F.col("base_failed"), none).otherwise(broken)
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, docs.columns, **params).where("kept").select("_row.*")
