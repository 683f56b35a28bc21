"""Centroid clustering with Ptolemaic pivots.

For points x, c and pivots p, s in Euclidean space, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).

The pivots are fixed before the first round, and each vector's distances to them are
computed once and stored beside it. In every round a task takes the largest bound over
the fixed pivot pairs for all its vectors and centroids at once, checks the centroid
with the smallest bound exactly, and then only those centroids whose bound does not
exceed that distance. Bounds are lowered by more than their rounding error, so no nearest
centroid, and no tied one, is ever pruned. Exact distances are sums of integer squares.

Each round leaves one partial sum for each task and centroid; they are added in Spark, and
the new centroids (``k`` rows, a parameter) come to the driver, which divides exactly.
Cached rows are read from a table written once, so a lost executor costs a re-read.

Vectors that are null, have another length than ``size``, or hold a null or non-finite
component are left out. A component x becomes floor(scale * x); beyond +-2^27, where a
squared distance would not fit a long, the job fails with a message. Repeated rows are
vectors of their own and may start several centroids. Rows without an id come last among
the starting vectors. Fewer vectors than ``k`` give fewer centroids; none, no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.session import materialize

#: Pivots; every two of them are a pair.
PIVOTS = 6
LARGEST = 1 << 27
#: Vectors that a task bounds at a time, and survivors it checks at a time.
ROWS, CHECKS = 1 << 12, 1 << 15


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two integer arrays."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different points, each the farthest from those before it."""
    if not len(points):
        return points
    taken = [0]
    far = exact(points, points[:1])
    while len(taken) < count and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, exact(points, points[taken[-1:]]))
    return points[taken]


def lengths(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every point to every pivot."""
    out = [np.sqrt(exact(points, p[None, :]).astype(np.float64)) for p in pivots]
    return np.stack(out, 1) if out else np.zeros((len(points), 0))


@dataclass
class Index:
    """Fixed pivots, and the centroids of a round with their pivot distances."""

    pivots: np.ndarray
    centroids: np.ndarray

    def __post_init__(self):
        self.near = lengths(self.centroids, self.pivots)
        i, j = np.triu_indices(len(self.pivots), 1)
        self.left, self.right = i, j
        self.apart = np.sqrt(exact(self.pivots[i], self.pivots[j]).astype(np.float64))

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """A lower bound of every squared distance, below it by more than its rounding."""
        low = np.zeros((len(cached), len(self.centroids)))
        for i, j, apart in zip(self.left, self.right, self.apart):
            a = np.multiply.outer(cached[:, i], self.near[:, j])
            b = np.multiply.outer(cached[:, j], self.near[:, i])
            # products, difference and quotient err by a few units in the last place of a and b
            np.maximum(low, (np.abs(a - b) - 1e-14 * (a + b)) / apart, out=low)
        return np.floor(np.square(low) * (1 - 1e-12))

    def assign(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: the smaller number), its squared distance, and how many
        distances were computed."""
        low = self.bounds(cached)
        guess = low.argmin(1)
        best = exact(x, self.centroids[guess])
        label = guess.copy()
        low[np.arange(len(x)), guess] = np.inf
        row, centroid = np.nonzero(low <= best[:, None])
        for k in range(0, len(row), CHECKS):
            r, c = row[k : k + CHECKS], centroid[k : k + CHECKS]
            d = exact(x[r], self.centroids[c])
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            top = np.r_[True, r[1:] != r[:-1]]
            r, c, d = r[top], c[top], d[top]
            less = (d < best[r]) | ((d == best[r]) & (c < label[r]))
            best[r[less]], label[r[less]] = d[less], c[less]
        return label, best, len(x) + len(row)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def kept_vectors(vectors: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id`` and the integer components ``x`` of the vectors that are kept."""
    sound = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform("embedding", lambda e: F.floor(scale * e.cast("double")))
    fits = F.forall("x", lambda e: F.abs(e) < LARGEST)
    told = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("component beyond the range of exact distances")))
    return (
        vectors.where((F.size("embedding") == size) & sound)
        .select("vec_id", whole.alias("x"))
        .select("vec_id", told.cast("array<int>").alias("x"))
    )


def starts(kept: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The ``k`` vectors with the smallest digests of their ids."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(key.asc_nulls_last(), "x").select("x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _assigned(cached: DataFrame, index: Index, size: int):
    """Batches of (ids, vectors, labels, distances) of a task."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), size, np.int64)
                near = _matrix(part.column(2), len(index.pivots), np.float64) if len(index.pivots) else np.zeros((len(x), 0))
                label, best, checks = index.assign(x, near)
                yield part.column(0), x, label, best, checks

    return run


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, pivots: int = PIVOTS
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster`` and ``distance`` of every kept vector, and the centroids."""
    kept = kept_vectors(vectors, size, scale)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    centroids = starts(kept, k)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids
    fixed = spread(centroids, pivots)

    def measure(batches):
        for batch in batches:
            near = lengths(_matrix(batch.column(1), size, np.int64), fixed)
            flat = pa.array(near.reshape(-1))
            ends = pa.array(np.arange(0, near.size + 1, len(fixed)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "x", "near"]
            )

    cached = materialize(
        kept.mapInArrow(measure, f"vec_id {id_type}, x array<int>, near array<double>"), "pivot-vectors"
    )
    for _ in range(rounds):
        index = Index(fixed, centroids)
        run = _assigned(cached, index, size)

        def sums(batches, run=run, count=len(centroids)):
            total, times = np.zeros((count, size), np.int64), np.zeros(count, np.int64)
            for _, x, label, _, _ in run(batches):
                order = np.argsort(label, kind="stable")
                own, first, n = np.unique(label[order], return_index=True, return_counts=True)
                total[own] += np.add.reduceat(x[order], first, axis=0)
                times[own] += n
            own = np.flatnonzero(times)
            ends = pa.array(np.arange(0, len(own) * size + 1, size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(times[own]), pa.ListArray.from_arrays(ends, pa.array(total[own].reshape(-1)))],
                ["cluster", "n", "total"],
            )

        partial = cached.mapInArrow(sums, "cluster long, n long, total array<long>")
        wide = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"t{j}") for j in range(size)]
        for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # k rows
            centroids[row.cluster] = [int(row[f"t{j}"]) // row.n for j in range(size)]
    index = Index(fixed, centroids)
    run = _assigned(cached, index, size)

    def last(batches):
        for ids, _, label, best, _ in run(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(label.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"]
            )

    return cached.mapInArrow(last, f"vec_id {id_type}, cluster int, distance long"), centroids


def report(vectors: DataFrame, **params) -> DataFrame:
    """Cluster, distance, inertia and centroid digest of every kept vector."""
    found, centroids = cluster(vectors, **params)
    spark = vectors.sparkSession
    if not len(centroids):
        return found.selectExpr(
            "vec_id", "cluster", "distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
        )
    found = materialize(found, "pivot-clusters")
    spent = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    rows = [(c, spent.get(c, 0), sum(spent.values()), ",".join(map(str, x))) for c, x in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, parts string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2("parts", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(facts), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
