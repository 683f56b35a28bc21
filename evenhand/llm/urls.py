"""URL filters: fixed rules first, then a path-template tree per host.

Paths are split into segments; digits and hashes become wildcards of their shape. Urls are
counted per (host, typed path) in a partial aggregate, so the tree is built over branches,
not over urls. Fork by fork from the root of each host, down to the deepest, a branch is
merged with its siblings into one wildcard if what lies below it is distributed as below
all siblings of its depth together (total variation) and its labels agree with theirs (a
binomial bound); others stay literal. Each branch is compared with that sum, never with
each sibling. Where paths do not fork they stay literal, however long they are, and are
passed in one step. A leaf of the tree is a template. Its share of bad labels, smoothed to
the host's, which is smoothed to that of all hosts, rejects it.

All steps are built-in functions. Nulls: a null url, or one without ``://``, has empty
host and path, and no labels by default. Repeated rows count and are judged one by one.
Extra columns are ignored. An empty table gives no rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import sized
from evenhand.session import materialize

# The rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def typed(path: Column) -> Column:
    """The segments of a path with digits and hashes as wildcards of their shape."""

    def shape(s: Column) -> Column:
        hashed = s.rlike("[0-9]") & s.rlike("^[0-9a-fA-F]{8,}(-[0-9a-fA-F]+)*$") & s.rlike("[a-fA-F]")
        return F.when(hashed, "{hex}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))

    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), shape)


def forked(state: DataFrame) -> DataFrame:
    """Every branch with its ``prefix`` grown to the next fork of its node, and whether it goes
    on from there (``open``). A path that ends before the fork, or meets none, is whole.

    All paths of a node are held against its greatest, which none continues: the fork is
    where the first of them leaves it."""
    keys = ["host", "prefix"]
    own = state.withColumn("rest", F.slice("typed", F.size("prefix") + 1, F.size("typed")))
    top = own.groupBy(*keys).agg(F.max("rest").alias("top"))
    same = (
        "coalesce(nullif(array_position(transform(rest, (x, i) -> x <=> get(top, i)), false), 0) - 1,"
        " size(rest))"
    )
    own = own.join(sized(top, "url-top"), keys).withColumn("same", F.expr(same).cast("int")).drop("top")
    own = materialize(own, "url-same")
    fork = own.where("same < size(rest)").groupBy(*keys).agg(F.min("same").alias("fork"))
    return own.join(sized(fork, "url-forks"), keys, "left").select(
        "host",
        "typed",
        "n",
        "labelled",
        "bad",
        F.expr("concat(prefix, slice(rest, 1, least(coalesce(fork, size(rest)), size(rest))))").alias("prefix"),
        F.expr("fork IS NOT NULL AND size(rest) > fork").alias("open"),
    )


def templates(
    branches: DataFrame,
    tolerance: float = 0.2,
    sigmas: float = 3.0,
) -> DataFrame:
    """``host``, ``typed`` and the ``template`` its tree gives it.

    ``branches`` has ``host``, ``typed``, ``n``, ``labelled`` and ``bad``, one row each."""
    state = branches.withColumn("prefix", F.array().cast("array<string>"))
    whole = []
    while True:
        state = materialize(forked(state), "url-forked")
        whole.append(state.where(~F.col("open")).drop("open"))
        state = state.where("open").drop("open")
        if state.isEmpty():
            break
        level = F.size("prefix")
        here = state.withColumn("child", F.get("typed", level)).withColumn(
            "rest", F.array_join(F.slice("typed", level + 2, F.size("typed")), "/")
        )
        here = materialize(here, "url-level")
        below = here.groupBy("host", "prefix", "child", "rest").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
        )
        below = materialize(below, "url-below")
        keys = ["host", "prefix"]
        # siblings are compared with the sum of those that mostly go as deep as they do
        steps = F.size(F.filter(F.split("rest", "/"), lambda x: x != ""))
        deep = F.max_by(steps, F.struct("n", "rest"))
        one = below.groupBy(*keys, "child").agg(
            F.sum("n").alias("child_n"),
            F.sum("labelled").alias("child_labelled"),
            F.sum("bad").alias("child_bad"),
            deep.alias("deep"),
        )
        one = materialize(one, "url-children")
        keys = [*keys, "deep"]
        below = below.join(one.select("host", "prefix", "child", "child_n", "deep"), ["host", "prefix", "child"])
        shares = below.groupBy(*keys, "rest").agg(F.sum("n").alias("rest_n"))
        node = below.groupBy(*keys).agg(
            F.sum("n").alias("node_n"),
            F.sum("labelled").alias("node_labelled"),
            F.sum("bad").alias("node_bad"),
            F.count_distinct("rest").alias("rests"),
        )
        distance = (
            below.join(shares, [*keys, "rest"])
            .join(node.select(*keys, "node_n"), keys)
            .groupBy(*keys, "child")
            .agg(
                F.sum(
                    F.greatest(
                        F.col("n") / F.col("child_n") - F.col("rest_n") / F.col("node_n"), F.lit(0.0)
                    )
                ).alias("distance")
            )
        )
        p = "((node_bad + 1) / (node_labelled + 2))"
        alike = F.expr(
            f"distance <= {tolerance} + 0.5 * sqrt(rests / child_n) AND (child_labelled = 0 OR"
            f" abs(child_bad / child_labelled - node_bad / greatest(node_labelled, 1))"
            f" <= {sigmas} * sqrt({p} * (1 - {p}) / child_labelled))"
        )
        judged = one.join(distance, [*keys, "child"]).join(node, keys).withColumn("alike", alike)
        judged = materialize(judged.select(*keys, "child", "alike"), "url-judged")
        merging = judged.groupBy(*keys).agg(F.sum(F.col("alike").cast("int")).alias("merging"))
        tokens = judged.join(merging, keys).select(
            "host",
            "prefix",
            "child",
            F.when(F.col("alike") & (F.col("merging") > 1), "*").otherwise(F.col("child")).alias("token"),
        )
        state = here.join(sized(tokens, "url-tokens"), ["host", "prefix", "child"], "left").select(
            "host",
            "typed",
            "n",
            "labelled",
            "bad",
            F.concat("prefix", F.array("token")).alias("prefix"),
        )
    return reduce(DataFrame.union, whole).withColumn("template", F.concat(F.lit("/"), F.array_join("prefix", "/"))).drop("prefix")


def rejected(leaves: DataFrame, prior: float = 5.0, most_bad: float = 0.5) -> DataFrame:
    """Every (host, typed) with its template, smoothed share of bad labels and ``reject``."""
    host = leaves.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    every = leaves.agg(F.sum("labelled").alias("al"), F.sum("bad").alias("ab"))
    leaf = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
    share = "((ab + 1) / (al + 2))"
    at_host = f"((hb + {prior} * {share}) / (hl + {prior}))"
    scored = (
        leaf.join(host, "host")
        .join(F.broadcast(every))  # one row
        .withColumn("bad_share", F.expr(f"(tb + {prior} * {at_host}) / (tl + {prior})"))
    )
    return leaves.join(
        scored.select("host", "template", "bad_share", (F.col("bad_share") > most_bad).alias("reject")),
        ["host", "template"],
    ).select("host", "typed", "template", "bad_share", "reject")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, **params) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``bad_share``.

    ``labels``: ``page_id`` and ``bad`` (0 or 1) of some pages; repeated ones count once
    each page, bad if any is."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "typed", typed(F.col("path"))
    )
    if labels is None:
        labelled = split.withColumn("bad", F.lit(None).cast("int"))
    else:
        once = labels.groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("bad"))
        labelled = split.join(once, split.page_id == F.col("_id"), "left").drop("_id")
    labelled = materialize(labelled, "url-parts")
    branches = labelled.groupBy("host", "typed").agg(
        F.count("*").alias("n"),
        F.count("bad").alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
    )
    leaves = materialize(templates(materialize(branches, "url-branches")), "url-leaves")
    verdicts = sized(rejected(leaves, **params), "url-verdicts")
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    return labelled.join(verdicts, ["host", "typed"], "left").select(
        "page_id",
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"),
        "template",
        "bad_share",
    )


def number(url: Column) -> Column:
    """The last number of a url's path, as the id of the document behind it."""
    _, path = parts(url)
    return F.regexp_extract(path, "([0-9]{1,18})[^/0-9]*/?$", 1).try_cast("long")
