import hashlib

import numpy as np
import pytest

from evenhand.llm import pivots, queries


def brute(vectors, k=40, rounds=5):
    kept = [
        (i, [int(np.floor(256 * float(e))) for e in x])
        for i, x in vectors
        if x is not None and len(x) == 64 and all(e is not None and np.isfinite(e) for e in x)
    ]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = np.array([x for _, x in sorted(kept, key=key)[:k]], dtype=np.int64)
    x = np.array([x for _, x in kept], dtype=np.int64)

    def nearest():
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        label, _ = nearest()
        for j in set(label.tolist()):
            own = x[label == j]
            c[j] = [int(s) // len(own) for s in own.sum(0)]
    label, d = nearest()
    return sorted(
        (
            str(i), int(a), int(b), int(d[label == a].sum()), int(d.sum()),
            hashlib.sha256(",".join(map(str, c[a].tolist())).encode()).hexdigest(),
        )
        for (i, _), a, b in zip(kept, label, d)
    )


def run(spark, as_table, vectors, extra=""):
    rows = [(i, x, 0) for i, x in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").repartition(3)
    out = queries.op11_ptolemaic_clusters(spark, as_table(df, "embeddings"))
    assert out.columns[:3] == ["vec_id", "cluster", "distance"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_clusters_against_all_distances(spark, as_table):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.3, (30, 64))
    x = (base[rng.integers(0, 30, 700)] + rng.normal(0, 0.1, (700, 64))).astype(np.float32)
    vectors = [(int(i), [float(e) for e in v]) for i, v in enumerate(x)]
    vectors += [(700 + i, vectors[3][1]) for i in range(200)]  # copies
    vectors += vectors[:5]  # repeated rows
    vectors += [(None, vectors[9][1]), (2000, None), (2001, [0.5] * 63), (2002, [0.5] * 65), (2003, [])]
    vectors += [(2004, [float("nan")] + [0.0] * 63), (2005, [float("inf")] + [0.0] * 63), (2006, [None] + [0.0] * 63)]
    vectors += [(2007, [0.0] * 64), (2008, [1000.0] * 64), (2009, [-1000.0] * 64)]
    assert run(spark, as_table, vectors) == brute(vectors)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, as_table, n):
    vectors = [(i, [float(i)] * 64) for i in range(n)] + [(9, None)]
    assert run(spark, as_table, vectors) == brute(vectors)


def test_equal_vectors_have_no_pivot_pair(spark, as_table):
    vectors = [(i, [0.25] * 64) for i in range(50)]
    assert run(spark, as_table, vectors) == brute(vectors)


def test_bounds_never_exceed_distances_and_prune():
    rng = np.random.default_rng(2)
    for scale in (3, 200, 1 << 26):
        c = rng.integers(-scale, scale, (50, 64))
        # close to few points: what pruning lives from, and many ties at small scale
        x = c[rng.integers(0, 50, 3000)] + rng.integers(-scale // 9 - 1, scale // 9 + 2, (3000, 64))
        fixed = pivots.spread(c, 6)
        index = pivots.Index(fixed, c)
        low = index.bounds(pivots.lengths(x, fixed))
        d = np.stack([pivots.exact(x, p[None, :]) for p in c], 1)
        assert (low <= d).all()
        label, best, checks = index.assign(x, pivots.lengths(x, fixed))
        assert (label == d.argmin(1)).all() and (best == d.min(1)).all()
        assert checks < d.size  # some groups of distances are never computed


def test_components_beyond_the_range_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range"):
        pivots.report(df).collect()
