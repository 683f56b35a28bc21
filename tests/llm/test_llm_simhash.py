import random
import re
from collections import Counter

import numpy as np
import xxhash

from evenhand.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def union(pairs, n):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_forest_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(rng.integers(1, 250)), int(rng.integers(1, 20))
        x = rng.integers(0, 2**63, k, dtype=np.uint64)[rng.integers(0, k, n)]
        for _ in range(rng.integers(0, 6)):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        group = np.sort(rng.integers(0, rng.integers(1, 5), n))
        order = np.lexsort((simhash.gray_rank(x), group))
        x, group = x[order], group[order]
        pairs = [
            (i, j)
            for i in range(n)
            for j in range(i + 1, n)
            if group[i] == group[j] and (int(x[i]) ^ int(x[j])).bit_count() <= 3
        ]
        want, got = union(pairs, n), simhash.forest(group, x, 3).tolist()
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_gray_order():
    codes = [k ^ (k >> 1) for k in range(1000)]
    assert simhash.gray_rank(np.array(codes, np.uint64)).tolist() == list(range(1000))


def test_query(spark, rows, docs, crowded, none, as_table):
    run = queries.QUERIES["op7_simhash"]
    got = run(spark, as_table(docs)).collect()
    fp = [plain(r[1]) for r in rows]
    n = len(rows)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = union(pairs, n)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    want = Counter((r[0], f"{fp[k]:016x}", least.get(root[k])) for k, r in enumerate(rows))
    assert Counter(map(tuple, got)) == want
    assert Counter(map(tuple, run(spark, as_table(crowded)).collect())) == want
    assert run(spark, as_table(none)).count() == 0
    kept = simhash.keep_one(crowded)
    assert kept.columns == crowded.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.get(k) for k in set(root))


def test_chains_and_dense_clusters(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base[:5]:  # chains: each three bits from the one before
        x = b
        for _ in range(40):
            for _ in range(3):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    for _ in range(2000):  # a dense cluster over eleven bits
        values.add(base[9] ^ rng.getrandbits(11))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    marked = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(marked).collect()}
    x = np.array(values, np.uint64)
    pairs = [
        (i, int(j))
        for i in range(len(x))
        for j in i + 1 + np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3)
    ]
    assert [got[s] for s in signed] == union(pairs, len(x))
