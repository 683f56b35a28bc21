"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, hash of the id): equal texts lie together. A
size-weighted sample of keys gives quantile boundaries of many small ranges; a boundary
moves to the edge of its group of equal texts unless the group itself spans several
ranges. The ranges' exact bytes are then counted, and an overfull range is subdivided at
boundaries sampled inside it, until it holds one key or is small enough. Ranges are dealt
to the shards, largest first, each to the shard with the fewest bytes. Slots run through
the ranges of a shard in order; a row's place comes from its own range alone, so no task
holds a shard.

Only the sample and one row for each range (their numbers are parameters) reach the
driver. Draws are hashes of keys: reruns agree. Nulls: a null text has no bytes and the
hash of the empty text; a null id is hashed like any other. Repeated rows are rows of
their own. An empty table gives no rows. Extra columns are ignored.
"""

import heapq
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from evenhand.session import materialize

OVERHEAD = 16
#: Ranges for each shard, least and most rows (on average) of a range, and sampled keys for
#: each range.
RANGES, LEAST_ROWS, RANGE_ROWS, SAMPLE = 64, 2, 50_000, 32
#: A divisible range over this many times the mean is subdivided.
OVERFULL = 2.0


@dataclass
class Splitters:
    """Boundaries in order; a key's range is the number of boundaries not above it."""

    group: np.ndarray
    sub: np.ndarray

    def ranges(self, group: np.ndarray, sub: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.group, group, "left")
        high = np.searchsorted(self.group, group, "right")
        out = low.copy()
        for g in np.unique(group[high > low]):
            a, b = np.searchsorted(self.group, g, "left"), np.searchsorted(self.group, g, "right")
            own = group == g
            out[own] = a + np.searchsorted(self.sub[a:b], sub[own], "right")
        return out

    def merged(self, other: "Splitters") -> "Splitters":
        both = pd.DataFrame(
            {
                "g": np.concatenate([self.group, other.group]),
                "s": np.concatenate([self.sub, other.sub]),
            }
        )
        both = both.drop_duplicates().sort_values(["g", "s"])
        return Splitters(both["g"].to_numpy(), both["s"].to_numpy())


def quantiles(sample: pd.DataFrame, count: int, whole_groups: bool) -> Splitters:
    """``count`` - 1 boundaries at equal weight between them."""
    if not len(sample) or count < 2:
        return Splitters(np.zeros(0, np.int64), np.zeros(0, np.int64))
    s = sample.sort_values(["group", "sub"])
    upto = s["weight"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, count) / count))
    at = at[at < len(s)]
    group, sub = s["group"].to_numpy()[at], s["sub"].to_numpy()[at].copy()
    if whole_groups:
        _, where, times = np.unique(group, return_inverse=True, return_counts=True)
        sub[times[where] == 1] = np.iinfo(np.int64).min
    return Splitters(group, sub)


def _second(sample: pd.DataFrame) -> Splitters:
    """A boundary at the second key, which always divides the range the sample is from."""
    keys = sample[["group", "sub"]].drop_duplicates().sort_values(["group", "sub"])
    return Splitters(keys["group"].to_numpy()[1:2], keys["sub"].to_numpy()[1:2])


def _draw(light: DataFrame, total: int, keys: int, salt: int) -> pd.DataFrame:
    """About ``keys`` keys, each drawn with a chance in proportion to its size."""
    level = max(total / max(keys, 1), 1.0)
    u = F.pmod(F.xxhash64("group", "sub", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return (
        light.where(u * level < F.col("size"))
        .select("group", "sub", F.greatest(F.col("size").cast("double"), F.lit(level)).alias("weight"))
        .toPandas()
    )


def _dealt(light: DataFrame, splitters: Splitters) -> DataFrame:
    @F.pandas_udf(T.LongType())
    def place(group: pd.Series, sub: pd.Series) -> pd.Series:
        return pd.Series(splitters.ranges(group.to_numpy(), sub.to_numpy()))

    return light.withColumn("range", place("group", "sub"))


def _filled(dealt: DataFrame) -> pd.DataFrame:
    return (
        dealt.groupBy("range")
        .agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min(F.struct("group", "sub")).alias("a"), F.max(F.struct("group", "sub")).alias("b"))
        .select("range", "size", "rows", (F.col("a") != F.col("b")).alias("divisible"))
        .orderBy("range")
        .toPandas()
    )


def shard(docs: DataFrame, shards: int = 40, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.xxhash64(F.col("doc_id"), F.xxhash64(text)).alias("sub"),
    )
    light = materialize(light, "shard-sizes")
    total, rows = light.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    each = min(ranges, max(4, rows // (shards * LEAST_ROWS)))
    count = max(shards * each, rows // RANGE_ROWS)
    splitters = quantiles(_draw(light, total, count * sample, 0), count, True)
    for k in itertools.count(1):  # each round halves what is overfull, down to single keys
        filled = _filled(_dealt(light, splitters))
        over = filled[(filled["size"] > OVERFULL * total / count) & filled["divisible"]]
        if not len(over):
            break
        inside = _dealt(light, splitters).where(F.col("range").isin(over["range"].tolist()))
        # an overfull range gets boundaries even where its keys are few or small
        drawn = _draw(inside, total, count * sample * 4**k, k)
        where = splitters.ranges(drawn["group"].to_numpy(), drawn["sub"].to_numpy())
        for r, size in zip(over["range"], over["size"]):
            parts = int(np.ceil(2 * size * count / total))
            own = drawn[where == r]
            splitters = splitters.merged(quantiles(own, parts, False)).merged(_second(own))
    # ranges to shards: the largest first, each to the emptiest shard
    load = [(0, s) for s in range(shards)]
    owner = {}
    for r, size in sorted(zip(filled["range"], filled["size"]), key=lambda x: (-x[1], x[0])):
        held, s = heapq.heappop(load)
        owner[r] = s
        heapq.heappush(load, (held + int(size), s))
    filled["shard"] = [owner[r] for r in filled["range"]]
    filled["first"] = filled.groupby("shard")["rows"].cumsum() - filled["rows"]
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(int(a), int(b), int(c)) for a, b, c in filled[["range", "shard", "first"]].itertuples(index=False)],
        "_range long, shard int, first long",
    )
    dealt = _dealt(light, splitters)
    order = "row_number() OVER (PARTITION BY range ORDER BY group, sub, doc_id, size) - 1"
    return (
        dealt.withColumn("at", F.expr(order))
        .join(F.broadcast(plan), F.col("range") == F.col("_range"))  # one row for each range
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot")
        )
    )
