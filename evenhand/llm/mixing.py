"""Mixing sources to target weights by permuted blocks.

The words of a source are packed, document after document, into blocks of a fixed number
of words. Each output shard draws how many of its slots every source fills: the whole
part of the expected count, and a multinomial draw for the rest. The slots of a source
are numbered through all shards; slot number ``i`` maps to block ``permute(i mod N)`` of
epoch ``i div N``, a pseudorandom permutation of the source's N block indexes, so every
block is used once before any is used again. Slots and blocks meet in a join on (source,
block index). A slot that would use a block a third time stays empty.

All draws are seeded by hashes of keys, so reruns and retried tasks agree. The place of
a document in its source comes from sums per hash bucket and a running sum inside each
bucket, so that no task holds a whole source.

Nulls: a null text has no words; the null source is a source, last in order. Repeated
rows are documents of their own. Documents without words are never taken. An empty table
gives no rows. Extra columns are carried in a struct and cannot clash.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from evenhand.llm.common import GAP, WORD, keyed, portions, row_key, sized
from evenhand.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
#: Documents for each hash bucket of a source, and the least number of buckets.
BUCKET_DOCS, BUCKETS = 4096, 256

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Image of each ``index`` < ``n`` under the permutation of 0..n-1 that ``seed`` names.

    A Feistel network over the next even power of two; images outside are sent on."""
    size = np.maximum(n.astype(np.int64), 2)
    half = ((np.ceil(np.log2(size)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, key = index.astype(np.uint64), _mix(seed.astype(np.int64).view(np.uint64))
    todo = np.arange(len(x))
    limit = n.astype(np.uint64)
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            with np.errstate(over="ignore"):
                f = _mix(right + key[todo] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1))
            left, right = right, left ^ (f & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= limit[todo]]
    return x.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(index: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permute(index.to_numpy(), n.to_numpy(), seed.to_numpy()))


def n_words(text):
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``place`` (order by code point, null last), ``total``, ``target``.

    Sources share ``share`` of all words by weight; none gets over ``most`` times its own,
    and what is over goes to the others by weight. In order of ``most * total / weight``
    the capped sources come first, so one running sum finds the level of the rest."""
    cycle = F.array(*[F.lit(w) for w in weights])
    total = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    ranked = total.withColumn(
        "place", F.expr("row_number() OVER (ORDER BY source NULLS LAST) - 1")
    ).withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights)))))
    order = f"ORDER BY {most} * total / weight, place ROWS BETWEEN"
    level = ranked.withColumn(
        "level",
        F.expr(
            f"({share} * sum(total) OVER () - coalesce(sum({most} * total) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
            f" / sum(weight) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING)"
        ),
    ).withColumn("capped", F.expr(f"{most} * total <= weight * level"))
    rest = level.withColumn(
        "rest", F.expr(
            f"min_by(level, CASE WHEN NOT capped THEN struct({most} * total / weight, place) END) OVER ()"
        ),
    )
    return rest.select(
        "source",
        "place",
        "total",
        F.expr(
            f"CAST(CASE WHEN rest IS NULL THEN {most} * total ELSE least({most} * total, weight * rest) END AS DOUBLE)"
        ).alias("target"),
    )


def placed(light: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its source's figures and ``start``, its first word's number in
    the source."""
    n = light.count()
    buckets = max(BUCKETS, n // BUCKET_DOCS)
    known = light.join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    known = known.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    known = materialize(known, "mix-bucketed")
    sums = known.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select(
        F.col("place").alias("_place"),
        F.col("bucket").alias("_bucket"),
        F.expr("sum(words) OVER (PARTITION BY place ORDER BY bucket) - words").alias("before"),
    )
    before = sized(before, "mix-buckets")
    inside = known.withColumn(
        "inside",
        F.expr(
            "sum(size) OVER (PARTITION BY place, bucket ORDER BY key, doc_id, uid"
            " ROWS UNBOUNDED PRECEDING) - size"
        ),
    )
    return (
        inside.join(before, (F.col("place") == F.col("_place")) & (F.col("bucket") == F.col("_bucket")))
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("_place", "_bucket", "before", "inside", "bucket", "key")
    )


def slots(sources: DataFrame, block: int, shard_blocks: int, seed: int) -> DataFrame:
    """``shard``, ``place``, ``slot``, ``epoch`` and ``block`` of every filled slot."""
    spark = sources.sparkSession
    wanted = sources.where("total > 0").select(
        "place",
        F.ceil(F.col("total") / block).alias("blocks"),
        (F.col("target") * F.ceil(F.col("total") / block) / F.col("total")).alias("wanted"),
    )
    all_ = wanted.agg(F.sum("wanted")).first()[0] or 0.0
    count = round(all_)
    shards = -(-count // shard_blocks)
    if not shards:
        return spark.createDataFrame([], "shard long, place int, slot long, epoch long, block long")
    cells = wanted.select(
        "place",
        "blocks",
        (F.col("wanted") / all_).alias("p"),
        F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"),
    )

    def draw(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("place")
        shard = int(cell["shard"].iloc[0])
        size = min(shard_blocks, count - shard * shard_blocks)
        mean = size * cell["p"].to_numpy()
        whole = np.floor(mean)
        part = mean - whole
        rest = size - int(whole.sum())
        n = whole.astype(np.int64)
        if rest > 0:
            odds = part / part.sum() if part.sum() > 0 else cell["p"].to_numpy() / cell["p"].sum()
            n += np.random.default_rng([seed, shard]).multinomial(rest, odds)
        return cell.assign(n=n)[["shard", "place", "blocks", "n"]]

    drawn = cells.groupBy("shard").applyInPandas(draw, "shard long, place int, blocks long, n long")
    first = drawn.withColumn(
        "first", F.expr("sum(n) OVER (PARTITION BY place ORDER BY shard) - n")
    ).where("n > 0")
    return (
        materialize(first, "mix-draws")
        .repartition("shard", "place")
        .select(
            "shard",
            "place",
            "blocks",
            F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"),
        )
        .where(f"slot < {MOST} * blocks")
        .withColumn("epoch", F.expr("slot DIV blocks"))
        .withColumn(
            "block",
            _permuted(
                F.expr("slot % blocks"), "blocks", F.xxhash64(F.lit(seed), "place", "epoch")
            ),
        )
        .select("shard", "place", "slot", "epoch", "block")
    )


def pieces(known: DataFrame, filled: DataFrame, block: int) -> DataFrame:
    """The part of each document that each of its blocks holds, and how often it is taken:
    the columns of ``known`` with ``from_word``, ``to_word`` (in the document) and ``times``."""
    times = filled.groupBy(F.col("place").alias("_place"), F.col("block").alias("_block")).agg(
        F.count("*").alias("times")
    )
    spread = known.where("size > 0").withColumn(
        "block",
        F.explode(F.expr(f"sequence(start DIV {block}, (start + size - 1) DIV {block})")),
    )
    # both sides grow with the corpus, though the draws' files look small
    return (
        spread.join(
            times.hint("merge"),
            (F.col("place") == F.col("_place")) & (F.col("block") == F.col("_block")),
        )
        .withColumn("from_word", F.expr(f"greatest(block * {block} - start, 0)"))
        .withColumn("to_word", F.expr(f"least((block + 1) * {block} - start, size)"))
        .drop("_place", "_block", "block")
    )


def mix(
    docs: DataFrame,
    block: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 20,
):
    """(documents, pieces): every row with ``uid``, ``row`` (its key), ``size``, ``total``,
    ``target`` and ``start``; and what the mix takes of each."""
    text = F.col("text").cast("string")
    cols = [
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(F.col("doc_id"), text).alias("key"),
        row_key().alias("row"),
    ]
    light = docs.select(*cols).withColumn("uid", F.monotonically_increasing_id())
    light = materialize(light, "mix-sizes")
    sources = sized(targets(light.select("source", "size")), "mix-targets")
    known = materialize(placed(light, sources), "mix-placed")
    taken = pieces(known, slots(sources, block, shard_blocks, seed), block)
    return known, taken


def report(docs: DataFrame, **params) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every row."""
    known, taken = mix(docs, **params)
    sums = taken.groupBy(F.col("uid").alias("_uid")).agg(
        F.sum(F.expr("(to_word - from_word) * times")).alias("taken")
    )
    return known.join(sums.hint("merge"), known.uid == F.col("_uid"), "left").select(
        "doc_id",
        "size",
        F.col("total").alias("source_size"),
        "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
    )


def cut(text: str, spans: list[tuple[int, int]], size: int) -> str:
    """The words from_word..to_word of each span with what stands between them."""
    if len(spans) == 1 and spans[0] == (0, size):
        return text
    words = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in spans)


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: one row for each document and use of it, with the text its
    drawn blocks hold (the whole text where all are drawn) and ``n_chars`` set anew.

    The uses are worked out on sizes alone; the texts are then read again and shuffled
    once, whatever the size."""
    _, taken = mix(docs, **params)
    uses = (
        taken.withColumn("use", F.explode(F.expr("sequence(1, times)")))
        .groupBy(F.col("uid"), F.col("row").alias("_key"), "use", "size")
        .agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"))
    )
    uses = materialize(uses.select("_key", "spans", "size"), "mix-uses").hint("merge")
    joined = keyed(docs).join(uses, "_key").select("_row", "spans", "size")
    row = joined.schema["_row"].dataType
    names = [f.name for f in row.fields]

    at = names.index("text")

    def run(batches):
        for batch in portions(batches, lambda b: b.column(0).field(at).cast(pa.string())):
            old = batch.column(0)
            texts = old.field(at).to_pylist()
            new = []
            for text, spans, size in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["from_word"]:
                        runs[-1][1] = s["to_word"]
                    else:
                        runs.append([s["from_word"], s["to_word"]])
                new.append(cut(text, [tuple(r) for r in runs], size))
            cols = [old.field(i) for i in range(len(names))]
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = joined.mapInArrow(run, row)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in names])
