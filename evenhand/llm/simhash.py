"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are joined, not documents: copies collapse in a partial aggregate
first. The upper nodes of the index are masked bit patterns. With at most d differing
bits, one of d + 1 blocks of the fingerprint is equal in both, so the pattern of each
block is a node, and every fingerprint lies below d + 1 of them; these nodes are dealt
over the cluster. Below a node the fingerprints are sorted by Gray rank (neighbours in
that order differ in few bits), cut into leaves, and the leaves joined pairwise upward;
every node keeps the bits that all below it share, as a mask and a value. Two nodes
whose shared bits already differ in more than d places are pruned with all below them:
masks only grow downward, so the count of differences only accumulates. Two nodes that
lie wholly in one component are pruned too, since no link between them can change the
result; this keeps a dense cluster of near copies near-linear. A node's links leave it
as a forest, at most one edge for each fingerprint. Components of the edges are found by
minimum labels with pointer jumping, each round written to the shared folder.

Nulls: a null text has no words, fingerprint zero, and links like any other. A null
``doc_id`` is carried, and never the name of a component that has an id. Repeated rows
are copies of each other. Extra columns are ignored, or carried by :func:`keep_one`.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.common import keyed, row_key
from evenhand.session import materialize

SEED = 42
LEAF = 16
#: Pairs of nodes, or of leaves, that are compared at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, carry: list[str], shingle: int = 3) -> DataFrame:
    """``_row`` (the carried columns) and ``fp``, the fingerprint as a signed long."""
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        F.col("text").cast("string").alias("text"),
    )
    row = kept.schema["_row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(x.as_py() or b"", shingle) for x in texts]
            fp = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["_row", "fp"])

    return kept.mapInArrow(run, f"_row {row}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of each 64-bit pattern in the reflected Gray code."""
    y = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        y ^= y >> np.uint64(s)
    return y


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the links (a, b) in ``label``, in place; labels are roots."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _leaf_links(x, starts, ends, left, right, most, label):
    """Links between (or inside) pairs of leaves; already joined pairs are left out."""
    offset = np.arange(LEAF)
    i = starts[left][:, None, None] + offset[None, :, None]
    j = starts[right][:, None, None] + offset[None, None, :]
    ok = (i < ends[left][:, None, None]) & (j < ends[right][:, None, None]) & (i < j)
    i, j = np.broadcast_arrays(i, j)
    i, j = i[ok], j[ok]
    near = np.bitwise_count(x[i] ^ x[j]) <= most
    return i[near], j[near]


def forest(group: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Root (an index) of every fingerprint in the components linked within its group.

    ``group`` is sorted, and ``x`` sorted by Gray rank within each group."""
    n = len(x)
    label = np.arange(n)
    if n < 2:
        return label
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    # leaves: consecutive fingerprints of one group
    per = -(-sizes // LEAF)
    leaf_of_group = np.r_[0, np.cumsum(per)]
    owner = np.repeat(np.arange(len(first)), per)
    starts = first[owner] + (np.arange(leaf_of_group[-1]) - leaf_of_group[owner]) * LEAF
    ends = np.minimum(starts + LEAF, (first + sizes)[owner])
    # neighbours in Gray order first: most of a dense cluster is joined by these alone
    for step in (1, 2):
        a = np.arange(n - step)
        a = a[(group[a] == group[a + step]) & (np.bitwise_count(x[a] ^ x[a + step]) <= most)]
        _settle(label, a, a + step)
    # levels of the hierarchy, leaves first; nodes of a level lie group by group
    levels = []
    ones, ands = np.bitwise_or.reduceat(x, starts), np.bitwise_and.reduceat(x, starts)
    base = leaf_of_group
    while True:
        levels.append((ones, ands, base))
        width = np.diff(base)
        if width.max() <= 1:
            break
        up = np.r_[0, np.cumsum(-(-width // 2))]
        where = np.repeat(np.arange(len(width)), -(-width // 2))
        heads = base[where] + 2 * (np.arange(up[-1]) - up[where])
        ones, ands = np.bitwise_or.reduceat(ones, heads), np.bitwise_and.reduceat(ands, heads)
        base = up
    top = len(levels) - 1
    roots = np.flatnonzero(np.diff(levels[top][2]) == 1)
    at = levels[top][2][roots]
    stack = [(top, at[k : k + CHUNK], at[k : k + CHUNK], roots[k : k + CHUNK]) for k in range(0, len(at), CHUNK)]

    def span(level, node, g):
        """First and last leaf under each node."""
        low = leaf_of_group[g] + ((node - levels[level][2][g]) << level)
        return low, np.minimum(low + (1 << level), leaf_of_group[g + 1]) - 1

    even = lambda lo, hi: label_change[ends[hi] - 1] == label_change[starts[lo]]
    label_change = np.zeros(n, np.int64)
    fresh = -1
    while stack:
        level, left, right, g = stack.pop()
        if fresh != len(stack) // 64:  # joined runs are looked up anew now and then
            label_change = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            fresh = len(stack) // 64
        ones, ands, base = levels[level]
        shared = ~(ones[left] ^ ands[left]) & ~(ones[right] ^ ands[right])
        apart = np.bitwise_count((ands[left] ^ ands[right]) & shared)
        (l0, l1), (r0, r1) = span(level, left, g), span(level, right, g)
        joined = even(l0, l1) & even(r0, r1) & (label[starts[l0]] == label[starts[r0]])
        go = (apart <= most) & ~joined
        left, right, g = left[go], right[go], g[go]
        if not len(left):
            continue
        if level == 0:
            for k in range(0, len(left), CHUNK >> 4):
                s = slice(k, k + (CHUNK >> 4))
                _settle(label, *_leaf_links(x, starts, ends, left[s], right[s], most, label))
            fresh = -1
            continue
        # children of both nodes; a node with itself gives its two halves and their pair
        low, width = levels[level - 1][2], np.diff(levels[level - 1][2])
        lc = low[g] + 2 * (left - base[g])
        rc = low[g] + 2 * (right - base[g])
        last = low[g] + width[g]
        pairs = [(lc, rc), (lc, rc + 1), (lc + 1, rc), (lc + 1, rc + 1)]
        keep = [
            (a < last) & (b < last) & ((left != right) | (a <= b)) for a, b in pairs
        ]
        a = np.concatenate([p[0][k] for p, k in zip(pairs, keep)])
        b = np.concatenate([p[1][k] for p, k in zip(pairs, keep)])
        gg = np.concatenate([g[k] for k in keep])
        for k in range(0, len(a), CHUNK):
            stack.append((level - 1, a[k : k + CHUNK], b[k : k + CHUNK], gg[k : k + CHUNK]))
    return label


def block_masks(most: int, bits: int = 64) -> list[tuple[int, int]]:
    """Shift and mask of ``most`` + 1 blocks; of two fingerprints with at most ``most``
    differing bits, at least one block is equal."""
    edges = [bits * k // (most + 1) for k in range(most + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Edges (``a``, ``b``) between fingerprints, whose components are those of all links
    at ``most`` or fewer differing bits."""
    nodes = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("block"),
                    F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m)).alias("pattern"),
                )
                for k, (s, m) in enumerate(block_masks(most))
            ]
        )
    )
    dealt = distinct.select("fp", nodes.alias("node")).select("node.*", "fp")
    dealt = dealt.repartition("block", "pattern").sortWithinPartitions("block", "pattern")

    def edges(group, x):
        rank = gray_rank(x)
        order = np.lexsort((rank, group))
        group, x = group[order], x[order]
        root = forest(group, x, most)
        own = np.flatnonzero(root != np.arange(len(x)))
        return pa.RecordBatch.from_arrays(
            [pa.array(x[own].view(np.int64)), pa.array(x[root[own]].view(np.int64))], ["a", "b"]
        )

    def run(batches):
        # rows come node by node; whole nodes are handled together, about a million rows at a time
        held, size = [], 0
        for batch in batches:
            node = (batch.column(0).to_numpy().astype(np.int64) << 60) | batch.column(1).to_numpy()
            held.append((node, batch.column(2).to_numpy().view(np.uint64)))
            size += len(node)
            if size >= 1 << 20:
                group, x = (np.concatenate(p) for p in zip(*held))
                cut = np.searchsorted(group, group[-1]) if group[0] != group[-1] else 0
                if cut:
                    yield edges(group[:cut], x[:cut])
                held, size = [(group[cut:], x[cut:])], 0
        if held:
            group, x = (np.concatenate(p) for p in zip(*held))
            if len(x):
                yield edges(group, x)

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of each component, for all nodes with an edge.

    Each round takes the smallest root among the neighbours, then follows roots; the
    number of rounds is logarithmic on the star-shaped edges given here."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "simhash-edges")
    state = materialize(
        both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"),
        "simhash-roots",
    )
    while True:
        seen = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("seen"))
        near = state.join(seen, state.node == seen.a).select(
            "node", F.least("root", "seen").alias("root"), F.col("root").alias("was")
        )
        near = materialize(near, "simhash-near")
        up = near.select(F.col("node").alias("up"), F.col("root").alias("top"))
        # hooking: the old root learns the smaller root of its members
        hooks = near.groupBy(F.col("was").alias("hook")).agg(F.min("root").alias("hooked"))
        jump = (
            near.join(up, near.root == up.up, "left")
            .join(hooks, near.node == F.col("hook"), "left")
            .select(
                "node",
                F.least("root", F.coalesce("top", "root"), F.coalesce("hooked", "root")).alias("root"),
                "was",
            )
        )
        jump = materialize(jump, "simhash-jump")
        if jump.where("root <> was").isEmpty():
            return jump.select("node", "root")
        state = jump.select("node", "root")


def classes(marked: DataFrame, most: int = 3) -> DataFrame:
    """``fp``, ``component_id``: the smallest ``doc_id`` of each fingerprint's component.

    ``marked`` has ``doc_id`` and ``fp``."""
    distinct = materialize(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct"
    )
    root = components(links(distinct, most))
    named = distinct.join(root, distinct.fp == root.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = materialize(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    marked = materialize(
        fingerprints(docs, ["doc_id"], shingle).select("_row.doc_id", "fp"), "simhash-fingerprints"
    )
    return marked.join(classes(marked, most), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """Of each component the row with the smallest ``doc_id`` (of rows that agree in id,
    text and source, any one), with its own columns. Rows without an id give way to rows
    with one.

    Only ids and keys are kept while components are looked for; the texts are then read
    again and shuffled once, whatever the size."""
    plain = docs.select("doc_id", "text", row_key().alias("key"))
    marked = fingerprints(plain, ["doc_id", "key"], shingle)
    light = materialize(marked.select("_row.doc_id", "_row.key", "fp"), "simhash-marked")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")))
    distinct = materialize(
        light.groupBy("fp").agg(F.min("doc_id").alias("first_id"), best.alias("best")),
        "simhash-distinct",
    )
    root = components(links(distinct.select("fp"), most))
    chosen = (
        distinct.join(root, distinct.fp == root.node, "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.key").alias("_key"))
    )
    chosen = materialize(chosen, "simhash-chosen").hint("merge")
    return keyed(docs).join(chosen, "_key", "left_semi").select("_row.*")
