"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words in lower case and one end. Every word belongs to
a class: each of the most frequent words is one of its own, the rest share classes by their
last letters. A token is coded as the bits of its class, along a prefix code in which
frequent classes are short, and then as itself among the words of its class, by exact
training counts. Three predictors know each class bit: counts of zeros and ones at the
node of the code alone, after the class before, and (in hashed slots) after the two
classes before. Their log-odds are mixed by weights that a gate selects (how much the
longest context has seen), and the mix is refined by what was in fact seen where the
predictors stood as they do. Before that, one bit says whether the token is the one that
followed the same two words last time, in an earlier training text (of the whole corpus, in
the order of the rows) or earlier in the text itself; its predictor is the length of the run
of such hits. All bits and the choice within the class add up to the log probability of the text.

What is gathered grows with the corpus: the count of every training word, and slots of
the longest context in proportion to the training tokens, up to a bound on what a task
must hold (``SLOTS``). Weights, refinement and hit rates come from all training tokens,
each predicted from tables without itself: what a predictor can say is one of a few
states, so the tokens of a task shrink to a histogram of joint states, histograms add
up, and the weights are learnt online over their sum. Only tables of bounded size
are collected and sent.

Texts are kept as numbers into the word list of their block, so the words of a block are
looked up once for all its documents, and a task holds one block: about ``BLOCK_TOKENS``
tokens, or one text if it is longer. What followed two words in earlier blocks is found by a
shuffle: a block gives, for each pair of words, what it asks of the blocks before and what it
tells the blocks after, at most once each where no held-out text comes first (``_contexts``),
and gets back the answers by place (``_answers``). So the scores do not depend on how texts
fall into blocks. Pairs are told apart by 68 bits of hashes, followers by 40. A block is one
row with its words, so its pairs are made from it whenever they are needed: they are far
larger than the texts, go straight into a shuffle, a part of them in each of ``ROUNDS``
rounds, and are never written as a table.

Nulls: a null text has only the end; a null id counts as the empty text for the split.
Repeated rows count and are scored one by one. Without training text every word is new.
Extra columns are ignored; an empty table gives no rows.
"""

import functools
import heapq
import itertools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.common import lean
from evenhand.session import materialize, scratch_dir

#: Classes: the most frequent words, and those of all other words.
TOP, OTHERS = 191, 64
CLASSES = TOP + OTHERS
#: Slots of the longest context: least and most (as powers of two), training tokens a slot.
SLOTS, TOKENS_A_SLOT = (14, 22), 64
#: Tokens and distinct words of a block, bytes of its words one by one, and tokens handled at a time.
BLOCK_TOKENS, BLOCK_WORDS, BLOCK_BYTES, SPAN = 3 << 19, 300_000, 1 << 26, 1 << 14
#: Buckets of word pairs (as a power of two), and bytes of a pair and of its follower.
BUCKETS, PAIR_BYTES, NEXT_BYTES = 12, 7, 5
#: Parts of the buckets that are shuffled one after the other.
ROUNDS = 2
#: Numbers of the rows of a block: words are below, then answers of other blocks, its texts as
#: numbers into the words, and from ``_TEXT`` on its documents.
_FAR, _IDS, _TEXT = (1 << 30) - 2, (1 << 30) - 1, 1 << 30
#: Bytes of a row group of blocks, which is what one task reads at least.
ROW_GROUP = 16 << 20
#: Slots of a table slice.
SLICE = 1 << 16
#: States of the predictors: log-odds alone; log-odds and how much was seen (``GRADES``).
ODDS, FEW_ODDS = 16, 8
GRADES = np.array([0.5, 1.5, 3.5, 7.5, 31.5])
STATES = (ODDS, ODDS, FEW_ODDS * (len(GRADES) + 1))
JOINT = STATES[0] * STATES[1] * STATES[2]
#: Kinds of hit predictions: runs of 0 to 7 hits, from a training text or the text itself.
RUNS = 16
_NONE = 255


def prefix_code(counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes and bits of each class in the prefix code of least mean length."""
    heap = [(int(c), k, k) for k, c in enumerate(counts + 1)]
    heapq.heapify(heap)
    parent, bit, at = {}, {}, len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], bit[x], parent[y], bit[y] = at, 0, at, 1
        heapq.heappush(heap, (a + b, at, at))
        at += 1
    nodes, bits = [], []
    for k in range(len(counts)):
        path = []
        while k in parent:
            path.append((parent[k] - len(counts), bit[k]))
            k = parent[k]
        path = np.array(path[::-1], np.int64).reshape(-1, 2)
        nodes.append(path[:, 0])
        bits.append(path[:, 1])
    return nodes, bits


@dataclass
class Code:
    """The prefix code as flat arrays, and the number of hashed slots."""

    nodes: np.ndarray
    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray
    slots: int

    @classmethod
    def of(cls, counts: np.ndarray) -> "Code":
        nodes, bits = prefix_code(counts)
        size = np.array([len(x) for x in nodes])
        least, most = SLOTS
        power = int(np.clip(int(counts.sum()) // TOKENS_A_SLOT, 1 << least, 1 << most)).bit_length() - 1
        return cls(np.concatenate(nodes), np.concatenate(bits), np.cumsum(size) - size, size, 1 << power)

    @property
    def starts(self) -> tuple[int, int, int]:
        """Where each predictor's slots begin, and their number."""
        return len(self.size), len(self.size) * (1 + len(self.size)), len(self.size) * (1 + len(self.size)) + self.slots

    def places(self, own, before, second):
        """Token, bit and the three slots of every class bit of tokens of classes ``own``
        after ``before`` and ``second``."""
        size = self.size[own]
        token = np.repeat(np.arange(len(own)), size)
        at = np.arange(len(token)) + np.repeat(self.first[own] - (np.cumsum(size) - size), size)
        node = self.nodes[at]
        one, two, _ = self.starts
        k, odd = len(self.size), np.uint64(0x9E3779B97F4A7C15)
        # what a token gives to its slots is worked out once, not for each of its bits
        pair = np.repeat(((second * k + before) * k).astype(np.uint64) * odd, size)
        pair += (self.nodes.astype(np.uint64) * odd)[at]
        pair >>= np.uint64(65 - self.slots.bit_length())
        return token, self.bits[at], (node, np.repeat(one + before * k, size) + node, two + pair.view(np.int64))


def odds_state(n0, n1, levels: int):
    """One of ``levels`` steps of the log-odds."""
    odds = np.log((n1 + 0.4) / (n0 + 0.4))
    return np.clip(np.round((odds + 7) * ((levels - 1) / 14)), 0, levels - 1).astype(np.int64)


def states(n0, n1, code: Code) -> np.ndarray:
    """State of every slot from its counts."""
    one, two, _ = code.starts
    out = odds_state(n0, n1, ODDS)
    few = odds_state(n0[two:], n1[two:], FEW_ODDS)
    out[two:] = np.searchsorted(GRADES, n0[two:] + n1[two:]) * FEW_ODDS + few
    return out.astype(np.uint8)


@dataclass
class Tables:
    """The state of every slot: as it is, and without one zero, without one one."""

    code: Code
    plain: np.ndarray
    less: np.ndarray

    @classmethod
    def of(cls, code: Code, counts: np.ndarray) -> "Tables":
        n0, n1 = counts.reshape(2, -1).astype(np.float64)
        less = np.stack([states(np.maximum(n0 - 1, 0), n1, code), states(n0, np.maximum(n1 - 1, 0), code)])
        return cls(code, states(n0, n1, code), less)

    def joint(self, places, bit=None) -> np.ndarray:
        """Joint state of the predictors; with ``bit``, each bit is taken from its slots."""
        state = self.plain if bit is None else self.less.ravel()
        own = 0 if bit is None else bit * len(self.plain)
        a, b, c = (state[x + own] for x in places)
        return (a.astype(np.int64) * STATES[1] + b) * STATES[2] + c


def inputs() -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the three predictors in every joint state, and the gate."""
    a, b, c = np.unravel_index(np.arange(JOINT), STATES)
    step = lambda x, levels: x * (14 / (levels - 1)) - 7
    return np.stack([step(a, ODDS), step(b, ODDS), step(c % FEW_ODDS, FEW_ODDS)], 1), c // FEW_ODDS


def learn(histogram: np.ndarray, passes: int = 60, rate: float = 0.5) -> np.ndarray:
    """Chance of a one in every joint state: gated weights learnt by steps along the error,
    a random part of the histogram at a time, then refined by the counts of the state itself."""
    x, gate = inputs()
    n0, n1 = histogram.reshape(2, -1).astype(np.float64)
    n, gates = n0 + n1, len(GRADES) + 1
    weights = np.zeros((gates, 3))
    weights[:, 1] = 1.0  # before learning, the class before decides
    total = np.maximum(np.bincount(gate, n, gates), 1)
    square = np.stack([np.bincount(gate, n * x[:, k] ** 2, gates) for k in range(3)], 1) / total[:, None] + 1
    part = np.random.default_rng(9).integers(0, 4, len(n))
    for step in range(passes):
        for own in range(4):
            w = np.where(part == own, n, 0)
            p = 1 / (1 + np.exp(-np.clip((x * weights[gate]).sum(1), -20, 20)))
            error = np.where(part == own, n1, 0) - w * p
            pull = np.stack([np.bincount(gate, error * x[:, k], gates) for k in range(3)], 1)
            seen = np.maximum(np.bincount(gate, w, gates), 1)[:, None]
            weights += rate * 4 * pull / seen / square / (1 + step / 20)
    p = 1 / (1 + np.exp(-np.clip((x * weights[gate]).sum(1), -14, 14)))
    trust = 30.0
    return np.clip((n1 + trust * p) / (n + trust), 1e-6, 1 - 1e-6)


def packed(ids: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the high ones compress to nothing."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def held(doc_id) -> bool:
    text = "" if doc_id is None else str(doc_id)
    return zlib.crc32(text.encode()) % 7 == 2


def groups(batches):
    """Ids and words of texts, as many at a time as make a span of tokens."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        out, size = [], 0
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            words = (texts[i].as_py() or b"").lower().split()
            out.append((doc_id, words))
            size += len(words) + 1
            if size >= SPAN:
                yield out
                out, size = [], 0
        if out:
            yield out


def _blocks(docs: DataFrame) -> DataFrame:
    """One row for each block: its documents as numbers into its words, one after the other,
    those words (joined by blanks, which none holds), and their counts in its training documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_ids array<{kind}>, held array<boolean>, n_bytes array<long>, sizes array<int>, ids binary, words binary, counts binary"

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        rows, chunks, size, id_type = [], [], 0, None

        def row(texts, tokens, words):
            doc_ids, out, sizes = zip(*texts)
            counts = np.bincount(tokens[np.repeat(~np.array(out), sizes)], minlength=len(words))
            n_bytes = np.fromiter(map(len, words), np.int64, len(words))[tokens] + 1
            n_bytes = np.add.reduceat(n_bytes, np.cumsum(sizes) - sizes)
            cols = {
                "block": pa.array([block], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(id_type)),
                "held": pa.array([out], pa.list_(pa.bool_())),
                "n_bytes": pa.array([n_bytes], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int32())),
                "ids": pa.array([packed(tokens)], pa.binary()),
                "words": pa.array([b" ".join(words)], pa.binary()),
                "counts": pa.array([packed(counts)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        def close(end=False):
            nonlocal block, rows, chunks, size
            while rows and (end or size >= BLOCK_TOKENS or sum(c.nbytes for c in chunks) >= BLOCK_BYTES):
                every = pa.concat_arrays(chunks)
                # numbered as they first come, the end before all
                coded = pa.concat_arrays([pa.array([b""], every.type), every]).dictionary_encode()
                tokens = coded.indices.to_numpy()[1:]
                ends = np.cumsum([n for _, _, n in rows])
                known = np.maximum.accumulate(tokens)[ends - 1] + 1
                full = (ends >= BLOCK_TOKENS) | (known >= BLOCK_WORDS)
                n = int(full.argmax()) + 1 if full.any() else len(rows)
                cut = int(ends[n - 1])
                yield row(rows[:n], tokens[:cut], coded.dictionary.slice(0, int(known[n - 1])).to_pylist())
                rows, chunks, size, block = rows[n:], [every.slice(cut)], size - cut, block + 1

        for batch in batches:
            id_type = batch.column(0).type
            for group in groups([batch]):
                every = []
                for doc_id, words in group:
                    every += words
                    every.append(b"")
                    rows.append((doc_id, held(doc_id), len(words) + 1))
                chunks.append(pa.array(every, pa.large_binary()))
                size += len(every)
                yield from close()
        yield from close(end=True)

    return docs.mapInArrow(run, schema)


def _words(blocks: DataFrame) -> DataFrame:
    """The words of every block by number, with their counts."""

    def run(batches):
        for batch in batches:
            for block, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = words.split(b" "), unpacked(counts)
                for s in range(0, len(words), 1 << 16):
                    part = words[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block] * len(part), pa.int64()),
                            pa.array(range(s, s + len(part)), pa.int32()),
                            pa.array(part, pa.binary()),
                            pa.array(counts[s : s + len(part)], pa.int64()),
                        ],
                        ["block", "id", "word", "n"],
                    )

    return blocks.select("block", "words", "counts").mapInArrow(run, "block long, id int, word binary, n long")


def _pairs(tokens: np.ndarray, doc: np.ndarray, train: np.ndarray, part: np.ndarray | None = None):
    """Tokens that follow two words of their text, by those two words and then in order: where
    they are, where a pair begins, the place of the one that followed it last time in the block
    (-1: none), and whether that is in the same text. ``part``: the tokens to look at, with all
    that follow the same two words."""
    at = np.arange(2, max(2, len(tokens)), dtype=np.int32) if part is None else part
    at = at[doc[at] == doc[at - 2]]
    wide, long = int(tokens.max(initial=0)).bit_length(), len(tokens).bit_length()
    key = tokens[at - 1].astype(np.int64) << wide | tokens[at - 2]
    if 2 * wide + long < 64:  # pair and place in one number, whose sort is several times faster
        key = key << long | at
        key.sort()
        at = (key & ((1 << long) - 1)).astype(np.int32)
        key >>= long
    else:
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        del order
    place = np.arange(len(at), dtype=np.int32)
    first = _begins(key)
    del key
    # positions of a text follow each other, so its own last occurrence is the one before
    own = ~first & (doc[at[place - 1]] == doc[at])
    known = _last(train[at], first)
    known[own] = place[own] - 1
    return at, first, known, own


def _begins(key: np.ndarray) -> np.ndarray:
    """Where another key begins, in sorted ones."""
    return np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)


def _last(told: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place, the last one of its key before it that is ``told``, or -1."""
    place = np.arange(len(told), dtype=np.int32)
    known = np.maximum.accumulate(np.where(told, place, np.int32(-1)))
    known = np.r_[np.int32(-1), known[:-1]][: len(told)]
    known[known < np.maximum.accumulate(np.where(first, place, np.int32(0)))] = -1
    return known


def hits(tokens: np.ndarray, doc: np.ndarray, train: np.ndarray, far=None) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a block's texts, in order: whether it is the one that followed the
    same two words last time (in a training text before, or before in the text itself), and
    the kind of the prediction, 255 where there is none. ``far``: positions predicted by the
    blocks before, and whether rightly."""
    n = len(tokens)
    kind, hit = np.full(n, _NONE, np.uint8), np.zeros(n, bool)
    at, _, known, own = _pairs(tokens, doc, train)
    some = known >= 0
    to, known, own = at[some], at[known[some]], own[some]
    del at, some
    hit[to] = tokens[known] == tokens[to]
    if far is not None:
        hit[far[0]] = far[1]
        to, own = np.r_[to, far[0]], np.r_[own, np.zeros(len(far[0]), bool)]
    # hits in a row just before, within the text
    miss = np.maximum.accumulate(np.where(hit, np.int32(0), np.arange(n, dtype=np.int32)))
    run = np.r_[np.int32(0), np.arange(n - 1, dtype=np.int32) - miss[:-1]]
    run[np.r_[True, doc[1:] != doc[:-1]]] = 0
    kind[to] = np.minimum(run[to], RUNS // 2 - 1) * 2 + own
    return hit, kind


def _low_bytes(x: np.ndarray, width: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _number(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data), 8), np.uint8)
    out[:, : data.shape[1]] = data
    return out.view("<u8").ravel()


def _contexts(tokens: np.ndarray, doc: np.ndarray, train: np.ndarray, words: list[bytes], part: int | None = None):
    """Bucket by bucket, what a block asks of the blocks before (tokens whose two words before
    occurred in no training text before, nor before in the text) and tells the blocks after
    (the last in its training texts): hashes of the two words and the token, and the steps from
    place to place, times four, plus one if it asks, plus two if it tells. ``part``: only the
    buckets of this round."""
    odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    one = pd.util.hash_array(np.array(words, object), hash_key="evenhand.lm.pair", categorize=False)
    two = (one ^ one >> np.uint64(32)) * odd[1]
    two ^= two >> np.uint64(29)  # dealt out by other bits than those that tell pairs apart
    before, second = np.r_[0, tokens[:-1]], np.r_[0, 0, tokens[:-2]]
    mixed = lambda h, at: (h * odd[0])[second[at]] + (h * odd[1])[before[at]]
    dealt = lambda at: (mixed(two, at) >> np.uint64(64 - BUCKETS)).astype(np.uint16)
    some = None
    if part is not None:
        some = np.arange(2, max(2, len(tokens)), dtype=np.int32)
        some = some[dealt(slice(2, None)) % ROUNDS == part]
    at, first, known, _ = _pairs(tokens, doc, train, some)
    asks, tells = known < 0, np.zeros(len(at), bool)
    del some, known
    told = np.flatnonzero(train[at])
    run = np.cumsum(first)[told]
    tells[told] = np.r_[run[1:] != run[:-1], True][: len(told)]
    flags = np.zeros(len(tokens), np.uint8)
    flags[at] = asks + 2 * tells
    del first, asks, tells
    at = np.flatnonzero(flags)
    bucket = dealt(at)
    order = np.argsort(bucket, kind="stable")
    bucket, at = bucket[order], at[order]
    data = np.concatenate(
        [
            _low_bytes(mixed(one, at) >> np.uint64(64 - 8 * PAIR_BYTES), PAIR_BYTES),
            _low_bytes(one[tokens[at]] >> np.uint64(64 - 8 * NEXT_BYTES), NEXT_BYTES),
        ],
        axis=1,
    )
    edges = np.flatnonzero(_begins(bucket))
    steps = np.diff(at, prepend=0)
    steps[edges] = at[edges]
    steps = (steps << 2 | flags[at]).astype("<i4")
    for a, z in zip(edges, [*edges[1:], len(at)]):
        yield int(bucket[a]), data[a:z].tobytes(), packed(steps[a:z])


def _answered(data: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Of the pairs of a bucket, in order of blocks and places: 0 where nothing is asked or no
    earlier block has told, 2 where the last that told has the same follower, else 1."""
    pair, follower = _number(data[:, :PAIR_BYTES]), _number(data[:, PAIR_BYTES:])
    order = np.argsort(pair, kind="stable")
    # what a block asks lies at or before what it tells: what was told before is another block's
    known = _last((flags[order] & 2) > 0, _begins(pair[order]))
    some = ((flags[order] & 1) > 0) & (known >= 0)
    out = np.zeros(len(pair), np.uint8)
    to = order[some]
    out[to] = 1 + (follower[to] == follower[order[known[some]]])
    return out


def _asked(blocks: DataFrame, part: int) -> DataFrame:
    """The word pairs of every block in the buckets of a round (``_contexts``)."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c) for c in ("block", "held", "sizes", "ids", "words")]
            for block, out, sizes, ids, words in zip(*cols):
                sizes = sizes.values.to_numpy()
                doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                train = ~out.values.to_numpy(zero_copy_only=False)[doc]
                found = _contexts(unpacked(ids.as_py()), doc, train, words.as_py().split(b" "), part)
                while rows := list(itertools.islice(found, 256)):
                    buckets, pairs, places = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(buckets, pa.int32()),
                            pa.array([block.as_py()] * len(rows), pa.int64()),
                            pa.array(pairs, pa.binary()),
                            pa.array(places, pa.binary()),
                        ],
                        ["bucket", "block", "pairs", "places"],
                    )

    own = blocks.select("block", "held", "sizes", "ids", "words")
    return own.mapInArrow(run, "bucket int, block long, pairs binary, places binary")


def _answers(pairs: DataFrame) -> DataFrame:
    """For each block, the places whose token is predicted by an earlier block: the steps from
    one to the next, of twice the place, plus one for a hit."""
    asked = pairs.repartition("bucket").sortWithinPartitions("bucket", "block")

    def run(batches):
        bucket, rows = None, []

        def close():
            if len(rows) < 2:  # one block alone has no answers
                return
            data = np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows]).reshape(-1, PAIR_BYTES + NEXT_BYTES)
            places = [unpacked(r[2]) for r in rows]
            found = _answered(data, np.concatenate(places) & 3)
            out, a = [], 0
            for (block, _, _), steps in zip(rows, places):
                own = found[a : a + len(steps)]
                a += len(steps)
                at = np.flatnonzero(own)
                if len(at):
                    place = np.cumsum((steps >> 2).astype(np.int64))[at]
                    out.append((block, packed(np.diff(place * 2 + (own[at] == 2), prepend=0))))
            if out:
                block, far = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(far, pa.binary())], ["block", "far"])

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if own != bucket:
                    yield from close()
                    bucket, rows = own, []
                rows.append(row)
        yield from close()

    return asked.mapInArrow(run, "block long, far binary")


def _resolved(placed: DataFrame, doc_type: str, total: int, distinct: int, masses: np.ndarray) -> DataFrame:
    """Every document with its base score and, for the model, the classes of its tokens, the
    hits, and the log probability of its tokens within their classes (hits aside)."""

    def documents(lists, tokens, row):
        known, base, classes, within, far = lists
        doc_ids, held_out, n_bytes, sizes = row
        out, sizes = held_out.to_numpy(zero_copy_only=False), sizes.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        hit, kind = hits(tokens, doc, ~out[doc], (far >> 1, (far & 1) > 0))
        ends = np.cumsum(sizes)
        sums = [np.add.reduceat(x, ends - sizes) for x in (known[tokens], base[tokens], np.where(hit, 0.0, within[tokens]))]
        own = classes[tokens]
        mark = np.where(kind == _NONE, 0, 1 + kind * 2 + hit).astype(np.uint8)
        for a in range(0, len(sizes), 1000):
            z = min(a + 1000, len(sizes))
            cuts = [(ends[k] - sizes[k], ends[k]) for k in range(a, z)]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.slice(a, z - a),
                    held_out.slice(a, z - a),
                    pa.array(sizes[a:z], pa.int64()),
                    pa.array(sums[0][a:z].astype(np.int64)),
                    pa.array([total] * (z - a), pa.int64()),
                    pa.array(sums[1][a:z]),
                    pa.array(sums[2][a:z]),
                    n_bytes.slice(a, z - a),
                    pa.array([own[x:y].tobytes() for x, y in cuts], pa.binary()),
                    pa.array([mark[x:y].tobytes() for x, y in cuts], pa.binary()),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "within", "n_bytes", "classes", "marks"],
            )

    def run(batches):
        block, parts, fars, tokens, rows = None, [], [], None, []

        def close():
            if rows:
                at, c, own = (np.concatenate(p) for p in zip(*parts))
                order = np.argsort(at)
                c, own = c[order], own[order]
                base = np.log10((c + 1) / (total + 1 * (distinct + 1)))
                within = np.log10((c + 1) / (masses[own] + 1))
                far = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpacked(x), dtype=np.int64) for x in fars)])
                at, *row = (pa.concat_arrays(x) for x in zip(*rows))
                row = [x.take(pa.array(np.argsort(at.to_numpy()))) for x in row]
                yield from documents((c > 0, base, own.astype(np.uint8), within, far), tokens, row)

        for batch in batches:
            blocks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            for a, z in zip(edges, [*edges[1:], len(blocks)]):
                if blocks[a] != block:
                    yield from close()
                    block, parts, fars, tokens, rows = blocks[a], [], [], None, []
                own, at = batch.slice(a, z - a), ids[a:z]
                some = lambda mask, *columns: [own.column(k).filter(pa.array(mask)) for k in columns]
                if (mask := at < _FAR).any():
                    parts.append([x.to_numpy() for x in some(mask, 1, 2, 3)])
                if (mask := at == _FAR).any():
                    fars += some(mask, 4)[0].to_pylist()
                for x in np.flatnonzero(at == _IDS):
                    tokens = unpacked(own.column(4)[int(x)].as_py())
                if (mask := at >= _TEXT).any():
                    rows.append(some(mask, 1, 5, 6, 7, 8))
        yield from close()

    return placed.mapInArrow(
        run,
        f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double,"
        " within double, n_bytes long, classes binary, marks binary",
    )


def _spans(batch: pa.RecordBatch, end: int):
    """Some texts at a time: their rows, where each begins, classes of the tokens and of the
    one and the two before, and the marks."""
    sizes = batch.column("n_tokens").to_numpy()
    upto = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SPAN, "right")))
        own, marks = (
            np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c).slice(a, z - a)])
            for c in ("classes", "marks")
        )
        begin = np.cumsum(sizes[a:z]) - sizes[a:z]
        own = own.astype(np.int64)
        before = np.r_[end, own[:-1]]
        before[begin] = end
        second = np.r_[end, before[:-1]]
        second[begin] = end
        yield slice(a, z), begin, own, before, second, marks.astype(np.int64)
        a = z


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays that tasks gave out in slices; ``size`` is bounded by parameters."""

    def add(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for width, part in zip(batch.column("width").to_pylist(), batch.column("part")):
                own = np.frombuffer(part.as_buffer(), f"<u{width}").astype("<i8")
                total = own if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "part"])

    out = np.zeros(size, np.int64)
    for at, part in parts.groupBy("at").applyInArrow(add, "at long, part binary").collect():
        own = np.frombuffer(part, "<i8")
        out[at : at + len(own)] = own
    return out


def _slices(total: np.ndarray):
    """An array in slices, each with as few bytes a number as its largest needs."""
    for s in range(0, len(total), SLICE):
        own = total[s : s + SLICE]
        if most := int(own.max(initial=0)):
            kind = np.min_scalar_type(most)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([kind.itemsize], pa.int32()), pa.array([own.astype(kind.newbyteorder("<")).tobytes()], pa.binary())],
                ["at", "width", "part"],
            )


_PART = "at long, width int, part binary"


def class_counts(coded: DataFrame, code: Code, end: int) -> np.ndarray:
    """Zeros, then ones, of every slot over all training texts."""
    size = code.starts[2]

    def run(batches):
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for _, _, own, before, second, _ in _spans(batch, end):
                _, bit, places = code.places(own, before, second)
                for x in places:
                    np.add.at(total, x + bit * size, 1)
        yield from _slices(total)

    train = coded.where("NOT held_out").select("n_tokens", "classes", "marks")
    return _summed(train.mapInArrow(run, _PART), 2 * size)


def histogram(coded: DataFrame, tables: Tables, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros, then ones, seen in every joint state by training texts, each bit left out of
    its own tables; and misses, then hits, of every kind of hit prediction."""

    def run(batches):
        total = np.zeros(2 * JOINT + 2 * RUNS, np.int64)
        for batch in batches:
            for _, _, own, before, second, marks in _spans(batch, end):
                hit = (marks > 0) & (marks % 2 == 0)
                some = marks[marks > 0] - 1
                total[2 * JOINT :] += np.bincount(some % 2 * RUNS + some // 2, minlength=2 * RUNS)
                _, bit, places = tables.code.places(own[~hit], before[~hit], second[~hit])
                total[: 2 * JOINT] += np.bincount(tables.joint(places, bit) + bit * JOINT, minlength=2 * JOINT)
        yield from _slices(total)

    train = coded.where("NOT held_out").select("n_tokens", "classes", "marks")
    found = _summed(train.mapInArrow(run, _PART), 2 * JOINT + 2 * RUNS)
    return found[: 2 * JOINT], found[2 * JOINT :]


def scored(coded: DataFrame, tables: Tables, chance: np.ndarray, rates: np.ndarray, end: int) -> DataFrame:
    """The rows with the model's ``score``."""
    cost = np.log10(np.r_[1 - chance, chance])
    hit_cost = np.log10(np.r_[1 - rates, rates])
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "n_bytes"]
    kinds = {c: coded.schema[c].dataType.simpleString() for c in names}

    def run(batches):
        for batch in batches:
            score = batch.column("within").to_numpy().copy()
            for rows, begin, own, before, second, marks in _spans(batch, end):
                hit = (marks > 0) & (marks % 2 == 0)
                token, bit, places = tables.code.places(own[~hit], before[~hit], second[~hit])
                each = np.zeros(len(own))
                each[~hit] = np.bincount(token, cost[tables.joint(places) + bit * JOINT], minlength=int((~hit).sum()))
                some = marks > 0
                m = marks[some] - 1
                each[some] += hit_cost[m % 2 * RUNS + m // 2]
                score[rows] += np.add.reduceat(each, begin)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], [*names, "score"])

    return coded.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", score double")


def _told(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All blocks, written once, and the answers each block gets from those before.

    The word pairs are the largest part. They are made anew from the blocks for each round, go
    through its shuffle and are gone with it."""
    spark, blocks = docs.sparkSession, _blocks(docs)
    path = f"{scratch_dir(spark).rstrip('/')}/lm-blocks-{uuid.uuid4().hex}"
    # a row is large: how much is held is looked at after each, not after a hundred
    sizes = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
    blocks.write.options(compression="zstd", **sizes).parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    rounds = [materialize(_answers(_asked(blocks, k)), "lm-answers") for k in range(ROUNDS)]
    return blocks, functools.reduce(DataFrame.union, rounds)


def scores(docs: DataFrame) -> DataFrame:
    """Base score and model score of every row."""
    with lean(docs.sparkSession):
        return _scores(docs)


def _scores(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks, answers = _told(docs)
    # one shuffle and sort by word give every row of a word its count, and mark one of them
    rows = "PARTITION BY word ORDER BY block"
    listed = _words(blocks).select(
        "block",
        "id",
        "word",
        F.expr(f"sum(n) OVER ({rows} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)").alias("c"),
        F.expr(f"row_number() OVER ({rows}) = 1").alias("first"),
    )
    listed = materialize(listed, "lm-words")
    vocabulary = listed.where("first AND c > 0").select("word", "c")
    top = [bytes(r.word) for r in vocabulary.orderBy(F.desc("c"), "word").limit(TOP).collect()]
    spark = docs.sparkSession
    rank = spark.createDataFrame([(w, k) for k, w in enumerate(top)], "word binary, rank int")
    ends = F.crc32(F.expr("substring(word, -3)")) % OTHERS
    own = F.coalesce("rank", (TOP + ends).cast("int")).alias("own")
    classed = lambda df: df.join(F.broadcast(rank), "word", "left")  # noqa: E731 at most TOP rows
    mass = classed(vocabulary).groupBy(own).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows
    counts, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in mass:
        counts[r.own], kinds[r.own] = r.n, r.v
    # rows of a block come together, and are put in order where they are used: Spark sorts by one number fastest
    rows = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "held", "n_bytes", "sizes")).alias("id", "row"))
    rows = rows.select("block", (F.lit(_TEXT) + F.col("id")).alias("id"), "row.doc_ids", "row.held", "row.n_bytes", "row.sizes")
    types = {"c": "long", "own": "int", "ids": "binary"} | {f.name: f.dataType for f in rows.schema}
    columns = ["block", "id", "c", "own", "ids", *rows.columns[2:]]
    filled = lambda df: df.select([df[c] if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in columns])
    placed = (
        filled(classed(listed).select("block", "id", "c", own))
        .union(filled(answers.select("block", F.lit(_FAR).alias("id"), F.col("far").alias("ids"))))
        .union(filled(blocks.select("block", F.lit(_IDS).alias("id"), "ids")))
        .union(filled(rows))
        .repartition("block")
        .sortWithinPartitions("block")
    )
    total, distinct = int(counts.sum()), int(kinds.sum())
    coded = materialize(_resolved(placed, docs.schema["doc_id"].dataType.simpleString(), total, distinct, counts + kinds), "lm-coded")
    end = top.index(b"") if b"" in top else int(TOP + zlib.crc32(b"") % OTHERS)
    code = Code.of(counts)
    tables = Tables.of(code, class_counts(coded, code, end))
    seen, found = histogram(coded, tables, end)
    misses, taken = found.reshape(2, -1)
    out = scored(coded, tables, learn(seen), (taken + 0.5) / (misses + taken + 1), end)
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")
    return out.withColumn("bits_per_byte", bits).drop("n_bytes")
