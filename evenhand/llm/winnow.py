"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points is hashed by a rolling polynomial; of each window of
``WINDOW`` consecutive hashes the smallest is chosen, the rightmost on ties, and kept with
its position. Two texts that share a passage of ``GRAM + WINDOW - 1`` code points (31) share
a chosen hash. A text with fewer hashes than a window is one window; one shorter than a
gram is hashed whole; the empty text has the empty fingerprint.

To compare each document with the next one by ``doc_id``, documents are dealt to parts of
neighbouring ids, the first document of a part is sent to the part before it as well, and
each part is read in order: a document's text crosses the network once, and a task holds
two texts at a time. The parts are ranges of (id, start of the text), found by Spark's range
partitioning of these keys alone; at most ``PARTS`` first keys go through the driver, one for
each part, and beyond ``PARTS * PART_BYTES`` the parts grow, not their number.

Nulls: a null text is empty; null ids come last. Documents with the same id follow each
other in order of their text, and may lie in several parts; those whose texts also start
alike pass through one part, one after another. A table with one row is its own next.
Ids may be of any type that Spark and Python order alike, such as numbers and strings.
Extra columns are ignored. An empty table gives no rows.
"""

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.session import materialize

GRAM, WINDOW = 16, 16
#: Bytes of text in a part, and the most parts.
PART_BYTES, PARTS = 16 << 20, 1 << 16
#: Code points of a text that order parts among documents of one id.
START = 64
#: Code points of results that a task holds before it hands them on.
HELD = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xD6E8FEB86659FD93)
_LAST = np.uint64(0xFFFFFFFF)


def grams(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hash of every run of ``gram`` (a power of two) codes, by doubling the runs."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64) + np.uint64(1)
        width, power = 1, _BASE
        while width < gram and len(h) > width:
            h = h[:-width] * power + h[width:]
            width, power = 2 * width, power * power
        if width < gram:  # a short text: one hash of the whole
            h = np.array([np.bitwise_xor.reduce(h * (np.arange(len(h), dtype=np.uint64) * _STIR + _BASE))])
        h = (h ^ (h >> np.uint64(32))) * _STIR
        return (h ^ (h >> np.uint64(32))) & _LAST


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Keys hash << 32 | (2^32 - 1 - position) of the chosen hashes, in order of position."""
    keys = (hashes << np.uint64(32)) | (_LAST - np.arange(len(hashes), dtype=np.uint64))
    if len(keys) <= window:
        return keys.min(keepdims=True)
    low, width = keys, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    return low[np.r_[True, low[1:] != low[:-1]]]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """The fingerprint as keys; empty for the empty text."""
    if not text:
        return np.zeros(0, np.uint64)
    return chosen(grams(np.frombuffer(text.encode("utf-32-le"), "<u4"), gram), window)


def written(keys: np.ndarray) -> str:
    """Base64 of the chosen grams: the four bytes of each hash, highest first, then the
    distance of its position from that of the gram before it (from -1 for the first) as
    groups of seven bits, lowest first, the eighth bit set where another group follows."""
    gaps = np.diff(positions(keys), prepend=-1)
    fits = gaps < 128
    if fits.all():
        out = np.empty((len(keys), 5), np.uint8)
        out[:, :4] = (keys >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
        out[:, 4] = gaps
        return base64.b64encode(out.tobytes()).decode()
    parts = []
    for h, gap in zip((keys >> np.uint64(32)).tolist(), gaps.tolist()):
        parts.append(h.to_bytes(4, "big"))
        while gap > 127:
            parts.append(bytes([128 | (gap & 127)]))
            gap >>= 7
        parts.append(bytes([gap]))
    return base64.b64encode(b"".join(parts)).decode()


def read(fingerprint: str) -> list[tuple[int, int]]:
    """Hash and position of every gram of a written fingerprint."""
    data, at, last, out = base64.b64decode(fingerprint), 0, -1, []
    while at < len(data):
        h, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        gap = shift = 0
        while data[at] > 127:
            gap, shift, at = gap | (data[at] & 127) << shift, shift + 7, at + 1
        last += gap | data[at] << shift
        at += 1
        out.append((h, last))
    return out


def positions(keys: np.ndarray) -> np.ndarray:
    """Position of every chosen gram."""
    return (_LAST - (keys & _LAST)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints; 1 for two empty ones."""
    x, y = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _order():
    """The key that orders documents into parts: null ids last, then the start of the text."""
    return F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.col("doc_id").alias("id"),
        F.left("text", F.lit(START)).alias("start"),
    )


def _firsts(docs: DataFrame) -> list[tuple]:
    """The first key of every part, in order; no part is empty."""
    light = docs.select(_order().alias("key"), F.octet_length("text").alias("size"))
    light = materialize(light, "winnow-keys")
    size = light.agg(F.sum("size")).first()[0] or 0
    count = int(min(max(8, size // PART_BYTES), PARTS))
    ranges = light.select("key").repartitionByRange(count, "key")
    first = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    return sorted(
        (tuple(r.key) for r in first.collect()),  # at most PARTS rows
        key=lambda k: _comparable(*k),
    )


def _comparable(none: bool, doc_id, start: str) -> tuple:
    return (1, 0, start) if none else (0, doc_id, start)


def compare(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The fingerprint of every text and of its edited text, and their likenesses."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    firsts = [_comparable(*k) for k in _firsts(docs)]
    parts = max(len(firsts), 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            ids, starts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            keys = [_comparable(i is None, i, s) for i, s in zip(ids, starts)]
            part = [max(bisect.bisect_right(firsts, k) - 1, 0) for k in keys]
            again = [k for k, p in enumerate(part) if keys[k] == firsts[p]]
            rows = pa.array([*range(len(ids)), *again], pa.int64())
            both = batch.take(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*part, *((part[k] - 1) % parts for k in again)], pa.int32()),
                    pa.array([False] * len(ids) + [True] * len(again)),
                    both.column(0),
                    both.column(1),
                ],
                ["part", "ahead", "doc_id", "text"],
            )

    keyed = docs.withColumn("start", F.left("text", F.lit(START)))
    dealt = keyed.mapInArrow(deal, f"part int, ahead boolean, doc_id {kind}, text string")
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions(
        "part", "ahead", F.col("doc_id").asc_nulls_last(), "text"
    )

    def follow(batches):
        held, out, size = None, [], 0
        for batch in batches:
            ahead, ids, texts = (batch.column(k) for k in (1, 2, 3))
            for k in range(len(ids)):
                more = ahead[k].as_py()
                if held is None and more:
                    continue  # another row with the key of the one ahead
                text = texts[k].as_py()
                keys = winnow(text, gram, window)
                if held is not None:
                    out.append(_row(held, text, keys, gram, window))
                    size += len(out[-1]["fingerprint"]) + len(out[-1]["edited_fingerprint"])
                held = None if more else (ids[k].as_py(), text, keys)
                if size > HELD:
                    yield pa.RecordBatch.from_pylist(out, _schema(ids.type))
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _schema(ids.type))
                out, size = [], 0

    return ordered.mapInArrow(
        follow,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    )


def _schema(kind: pa.DataType) -> pa.Schema:
    text = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    return pa.schema(
        [
            ("doc_id", kind),
            ("n_chars", pa.int64()),
            *[(c, pa.string()) for c in text],
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )


def _row(held, after: str, after_keys: np.ndarray, gram: int, window: int) -> dict:
    doc_id, text, keys = held
    new = edited(text, after)
    new_keys = winnow(new, gram, window)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
        "fingerprint": written(keys),
        "edited_fingerprint": written(new_keys),
        "near_edited": likeness(keys, new_keys),
        "near_next": likeness(keys, after_keys),
    }
