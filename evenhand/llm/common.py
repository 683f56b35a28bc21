"""Helpers shared by the corpus operators."""

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.session import materialize

#: A word, and what separates words, in the corpus contracts.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Most bytes (as JSON text) of a table that is broadcast.
BROADCAST_BYTES = 8 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def sized(df: DataFrame, label: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Write a table and mark it for broadcast only if its measured size allows.

    Beyond ``limit`` it joins by shuffle, where adaptive execution splits hot keys."""
    table = materialize(df, label)
    bytes_ = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if bytes_ <= limit else table


@contextlib.contextmanager
def lean(spark: SparkSession):
    """Inside, the files of a shuffle go as soon as what is made of them has been written."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def portions(
    batches: Iterator[pa.RecordBatch], texts: Callable[[pa.RecordBatch], pa.Array], limit: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, in batches that end once ``texts`` of theirs
    exceed ``limit`` bytes. What a batch took is given back to the system after it."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(texts(batch)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
        for a, b in zip([0, *ends], [*ends, len(sizes)]):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def row_key() -> Column:
    """96 bits of a document row's id, text and source, to find the row again by."""
    own = ["doc_id", F.col("text").cast("string"), "source"]
    return F.struct(F.xxhash64(*own).alias("a"), F.hash(*own).alias("b"))


def keyed(docs: DataFrame) -> DataFrame:
    """One row for each distinct key: ``_key`` and the whole row as ``_row``.

    A later join on ``_key`` uses the same shuffle."""
    packed = docs.select(
        row_key().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    )
    first = F.expr("row_number() OVER (PARTITION BY _key ORDER BY _key)")
    return packed.withColumn("_copy", first).where("_copy = 1").drop("_copy")
