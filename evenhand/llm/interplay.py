"""How filters interact: what each order of filters removes, from removal-game potentials.

Every text gets one bit for each filter it fails. The rows shrink to cells (part, bits,
labels) with a count, and the cells to the worth of each coalition: v(S) is the number
of documents that fail a filter of S. The potential of the removal game is then computed
recursively over the coalitions, P({}) = 0 and

    P(S) = (v(S) + sum of P(S - i) for i in S) / |S|,

and a filter's Shapley value is P(all) - P(all - i). It is kept in whole numbers as
Q(S) = |S|! P(S) = (|S| - 1)! v(S) + sum of Q(S - i). The step of an order that comes to
filter i after the filters S removes v(S + i) - v(S) documents, so all orders follow from
the 32 coalitions without a look at the rows.

"Same text as a smaller id" is decided without a task that holds a text's copies: rows
are counted per (text, part, ...) with map-side partial counts, and only those counts,
a few for each text, meet. Texts are compared by a 256-bit digest.

Nulls: a null text is the empty text, a null part the empty string. A null ``doc_id`` is
neither smaller nor greater than another id, so it fails no copy filter and is nobody's
first. Repeated rows (same id, same text) are no copies of each other. A document with
several label rows is good (toxic) if one of them says so. An empty table gives no rows.
Extra columns are ignored.
"""

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import GAP

LETTERS = "ABCDE"
SIZE = len(LETTERS)
ALL = (1 << SIZE) - 1


def text_fails(text: Column) -> dict[str, Column]:
    """The filters that look at the text alone."""
    words = F.array_remove(F.split(text, GAP), "")
    long = lambda c: c.cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * long(F.size(F.array_distinct(words))) < 80 * long(F.size(words)),
        "C": 100 * long(capitals) > 10 * long(F.length(text)),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Cells of ``part``, ``mask`` (bit k: fails filter k), ``good``, ``toxic`` and the
    number ``n`` of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text")
    )
    fails = text_fails(F.col("text"))
    mask = sum((F.when(fails[x], 1 << LETTERS.index(x)).otherwise(0) for x in "BCD"), F.when(fails["A"], 1).otherwise(0))
    light = light.select("doc_id", "part", F.sha2("text", 256).alias("digest"), mask.alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    marked = light.join(marks, light.doc_id == marks["_id"], "left").select(
        "doc_id", "part", "digest", "mask",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    kind = ["digest", "part", "mask", "good", "toxic"]
    # one row for each document, then a few for each text; both with map-side partial counts
    own = marked.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    kinds = own.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        first.alias("first"),
    )
    least = F.expr("min(first.doc_id) OVER (PARTITION BY digest)")
    fresh = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = kinds.withColumn("least", least).select(
        "part", "mask", "good", "toxic",
        F.explode(F.array(
            F.struct(F.lit(0).alias("copy"), fresh.alias("n")),
            F.struct(F.lit(1 << LETTERS.index("E")).alias("copy"), (F.col("n") - fresh).alias("n")),
        )).alias("x"),
    )
    return split.groupBy(
        "part", (F.col("mask") + F.col("x.copy")).alias("mask"), "good", "toxic"
    ).agg(F.sum("x.n").alias("n"))


def worths(cells: DataFrame) -> DataFrame:
    """``part``, ``total``, and by coalition (a bit pattern, so position) the documents
    failing one of its filters: ``v`` of all, ``good`` and ``toxic`` of the labelled."""

    def worth(of: Column) -> Column:
        return F.array(
            *[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, of).otherwise(0)) for s in range(ALL + 1)]
        )

    n = F.col("n")
    return cells.groupBy("part").agg(
        F.sum(n).alias("total"),
        worth(n).alias("v"),
        worth(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        worth(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, n).otherwise(0)) for k in range(SIZE)]).alias("fails"),
    )


def potentials(v: Column, size: int = SIZE) -> Column:
    """|S|! times the potential of every coalition S, by its bit pattern.

    Coalitions come by number: S without a member has a smaller one."""
    steps = [
        F.struct(
            F.lit(s).alias("s"),
            F.lit(math.factorial(max(s.bit_count() - 1, 0)) if s else 0).cast("long").alias("times"),
            F.array(*[F.lit(s ^ 1 << k) for k in range(size) if s >> k & 1]).cast("array<int>").alias("less"),
        )
        for s in range(1 << size)
    ]

    def step(done: Column, x: Column) -> Column:
        below = F.aggregate(x["less"], F.lit(0).cast("long"), lambda a, s: a + F.element_at(done, s + 1))
        return F.concat(done, F.array(x["times"] * F.element_at(v, x["s"] + 1) + below))

    return F.aggregate(F.array(*steps), F.array().cast("array<bigint>"), step)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    known = worths(failures(docs, labels, part)).withColumn("q", potentials(F.col("v")))
    value = F.array(
        *[F.element_at("q", ALL + 1) - SIZE * F.element_at("q", (ALL ^ 1 << k) + 1) for k in range(SIZE)]
    )
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(LETTERS)])
    each = known.select(
        F.col("part"), "total", "v", "good", "toxic", "fails", value.alias("value"),
        F.explode(orders).alias("filter_order"),
    )
    each = each.select("*", F.explode(F.array(*[F.lit(k) for k in range(1, SIZE + 1)])).alias("step"))
    bit = lambda k: F.expr(f"shiftleft(1, instr('{LETTERS}', substring(filter_order, {k}, 1)) - 1)")
    before = sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(2, SIZE)), F.when(F.col("step") > 1, bit(1)).otherwise(0))
    at = F.expr(f"instr('{LETTERS}', substring(filter_order, step, 1))")
    each = each.select("*", before.alias("s"), at.alias("i"))
    each = each.withColumn("t", F.col("s").bitwiseOR(F.expr("shiftleft(1, i - 1)")))
    gain = lambda c: F.element_at(c, F.col("t") + 1) - F.element_at(c, F.col("s") + 1)
    alone = F.element_at("v", ALL + 1) - F.element_at("v", F.lit(ALL) - F.expr("shiftleft(1, i - 1)") + 1)
    return each.select(
        "part", "filter_order", "step",
        (F.col("total") - F.element_at("v", F.col("t") + 1)).alias("kept"),
        gain("v").alias("removed"),
        (F.element_at("fails", F.col("i")) - gain("v")).alias("redundant"),
        alone.alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        F.element_at("value", F.col("i")).alias("shapley"),
    )
