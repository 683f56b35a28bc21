"""Byte-pair encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token marks a certain cut: no merge can
cross it, so the bytes on either side are encoded alone and the ids concatenated. The
pairs are read from the vocabulary, a 256 x 256 table. Of the certain cuts those are
used at which the pre-tokenizer's pattern cannot look across either (its only look-ahead
is at white space):

* before an ASCII white-space byte: a run of white space that ends at the cut is one
  piece on the left, and the pattern starts afresh at the rest of the run;
* between two ASCII bytes of different classes (letter, digit, other), the left one not
  white space: pieces end there in the whole text as well;
* between an ASCII byte that is not white space and a lead byte: the right side is the
  rest of the same piece, or a new one.

Strings of special tokens are taken out first, as the tokenizer does; each stretch
between them is encoded on its own. Fragments recur, so a worker keeps the ids of short
ones in a bounded table; a text is never cut by length. Decoding joins the bytes of the
ids and reads them as UTF-8.

Nulls: a null text is encoded as the empty text, and a null ``doc_id`` is carried.
Repeated rows give repeated rows. Only byte-level BPE vocabularies without a normalizer,
a prefix space or a template are supported; others raise ValueError.
"""

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fragments kept by a worker, and the longest that is kept, in bytes.
CACHE_FRAGMENTS = 500_000
CACHE_BYTES = 48

#: The pre-tokenizer's pattern, and the letters below which every Unicode version agrees on it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OLD_LETTERS = re.compile("[^\u0000-\u024f]")

_SPACE, _LETTER, _DIGIT, _OTHER, _LEAD, _TAIL = range(6)


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: the printable Latin-1
    characters stand for themselves, the other bytes for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_classes() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    for b in range(256):
        if b in b" \t\n\x0b\x0c\r":
            kinds[b] = _SPACE
        elif b >= 0x80:
            kinds[b] = _LEAD if b >= 0xC0 else _TAIL
        elif chr(b).isalpha():
            kinds[b] = _LETTER
        elif chr(b).isdigit():
            kinds[b] = _DIGIT
    return kinds


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """``[a * 256 + b]``: whether a text is cut between the bytes a and b."""
    certain = np.ones(65536, bool)
    for t in tokens:
        a = np.frombuffer(t, np.uint8).astype(np.int64)
        certain[a[:-1] * 256 + a[1:]] = False
    kinds = byte_classes()
    left, right = np.repeat(kinds, 256), np.tile(kinds, 256)
    plain = np.isin(left, (_LETTER, _DIGIT, _OTHER))
    blind = (
        (right == _SPACE)
        | (plain & np.isin(right, (_LETTER, _DIGIT, _OTHER)) & (left != right))
        | (plain & (right == _LEAD))
    )
    return certain & blind


class Codec:
    """One vocabulary: its cuts, its fragments' ids and its tokens' bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if (
            spec["model"]["type"] != "BPE"
            or spec.get("normalizer")
            or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or not pre.get("use_regex", True)
        ):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        letters = byte_letters()
        special = {t["content"]: t for t in spec.get("added_tokens") or ()}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special.values()):
            raise ValueError("special tokens that match more than their own text")
        plain = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = {k: int(t["id"]) for k, t in special.items()}
        self.bytes: list[bytes] = [b""] * (1 + max([*plain.values(), *self.special.values()]))
        for t, i in plain.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        self.cuts = cut_table([self.bytes[i] for i in plain.values()])
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        longest = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.ranked = self._ranked(spec["model"]["merges"], plain, letters)
        self.known: dict[bytes, bytes] = {}

    def _ranked(self, merges: list, plain: dict[str, int], letters: dict[str, int]):
        """The same merges in a faster encoder, if ids ascend as the merges do; else None."""
        import tiktoken

        joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges]
        made = [plain.get(m, -1) for m in joined]
        singles = sorted(i for t, i in plain.items() if len(t) == 1)
        if made != sorted(set(made)) or len(made) + len(singles) != len(plain) or singles[-1] > made[0]:
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in plain.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fragments(self, data: bytes) -> list[bytes]:
        if len(data) < 2:
            return [data] if data else []
        b = np.frombuffer(data, np.uint8).astype(np.uint16)
        at = np.flatnonzero(self.cuts[(b[:-1] << 8) | b[1:]]) + 1
        ends = at.tolist()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)])]

    def learn(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian bytes, of every fragment; short ones are remembered."""
        wanted = set(fragments)
        missing = [f for f in wanted if f not in self.known]
        if not missing:
            return self.known
        got, rest = {}, []
        for f in missing:
            text = f.decode()
            if self.ranked is None or OLD_LETTERS.search(text):
                rest.append(f)
            else:
                ids = self.ranked.encode_ordinary(text)
                got[f] = struct.pack(f"<{len(ids)}I", *ids)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            texts = [f.decode() for f in part]
            for f, e in zip(part, self.model.encode_batch_fast(texts, add_special_tokens=False)):
                got[f] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        if len(self.known) + len(got) > CACHE_FRAGMENTS:
            got |= {f: self.known[f] for f in wanted if f in self.known}
            self.known = {f: v for f, v in got.items() if len(f) <= CACHE_BYTES}
        else:
            self.known |= {f: v for f, v in got.items() if len(f) <= CACHE_BYTES}
        return got if len(got) == len(wanted) else self.known | got

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers."""
        plans: list[list[list[bytes] | int]] = []
        for text in texts:
            found = self.split is not None and self.split.search(text)
            parts = self.split.split(text) if found else [text]
            plans.append(
                [self.special[p] if i % 2 else self.fragments(p.encode()) for i, p in enumerate(parts)]
            )
        ids = self.learn([f for plan in plans for p in plan if type(p) is list for f in p])
        return [
            b"".join(
                b"".join(map(ids.__getitem__, p)) if type(p) is list else p.to_bytes(4, "little")
                for p in plan
            )
            for plan in plans
        ]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _slices(column: pa.ChunkedArray | pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` characters together; null becomes empty."""
    start, held, size = 0, [], 0
    for i in range(len(column)):
        held.append(column[i].as_py() or "")
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def encoded(docs: DataFrame, path: str, carry: list[str], digests: bool = False) -> DataFrame:
    """The carried columns with ``n_tokens``, and ``ids`` with ``exact`` (whether they decode
    to the text), or the digests of the ids and of the text decoded from them."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), "text")
    kept = kept.withColumn("text", F.col("text").cast("string"))
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, exact boolean"
    row = kept.schema["_row"].dataType.simpleString()
    schema = f"_row {row}, n_tokens long, {tail}"

    def run(batches):
        c = codec(path)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            for start, part in _slices(texts):
                ids = c.encode(part)
                out = [rows.slice(start, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    out.append(pa.array([sha(x) for x in ids], pa.string()))
                    out.append(pa.array([sha(c.decode(x).encode()) for x in ids], pa.string()))
                else:
                    values = np.frombuffer(b"".join(ids), "<i4")
                    ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                    out.append(pa.array([c.decode(x) == t for x, t in zip(ids, part)], pa.bool_()))
                names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "exact"]
                yield pa.RecordBatch.from_arrays(out, ["_row", "n_tokens", *names])

    return kept.mapInArrow(run, schema)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``ids`` (any columns, one of them ``ids``) with ``text`` decoded from them."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)

    def run(batches):
        c = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [
                c.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"]
            )

    return ids.mapInArrow(run, f"{fields}, text string")
