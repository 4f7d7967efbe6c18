"""Centroid clustering (Lloyd's rounds on integer vectors) with a LAESA pivot table.

Distances of every vector to a few fixed pivots are computed and stored once. In a round the centroids' distances to the
same pivots give, by the triangle inequality, a lower bound for each vector and centroid. The centroid with the least
bound is measured first; of the others only those whose bound is not above that distance are measured, exactly, in
integers. A task adds up its vectors a centroid, so k x dims sums leave a task and reach the driver, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import stored

#: The pivots are chosen among so many vectors (those of the smallest hashes) as far from each other as possible.
SAMPLE = 512
PIVOTS = 8
ROWS = 4096


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id and q, floor(scale * x) of each component; rows with another number of components, a null or a
    non-finite one are left out. A scaled component beyond 2^62 is an error."""
    infinite = F.lit(float("inf"))
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    scaled = F.transform(vec_col, lambda x: x.cast("double") * F.lit(float(scale)))
    small = F.forall("s", lambda x: F.abs(x) < F.lit(2.0**62))
    whole = vectors.filter((F.size(vec_col) == dims) & ok).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("s"))
    q = F.transform("s", lambda x: F.floor(x))
    return whole.select("vec_id", F.when(small, q).otherwise(F.raise_error(F.lit("a scaled component is beyond 2^62")).cast("array<bigint>")).alias("q"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, of Python integers where 64 bits might not hold their distances."""
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    return wide(m)


def wide(m: np.ndarray) -> np.ndarray:
    """Squared distances of components up to the limit fit in 64 bits."""
    limit = isqrt(((1 << 63) - 1) // (4 * m.shape[1]))
    return m.astype(object) if m.dtype != object and m.size and max(-int(m.min()), int(m.max())) > limit else m


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows (or of rows and one row)."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(-1)


def roots(x: np.ndarray) -> np.ndarray:
    """Exact integer square roots."""
    if x.dtype == object:
        return np.array([isqrt(int(v)) for v in x], object)
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def to_pivots(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """n x pivots: integer roots of the squared distances."""
    return np.stack([roots(squared(q, p)) for p in pivots], axis=1)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: the first vector, then ever the one whose nearest pivot is farthest (ties: the earlier)."""
    chosen, least = [0], squared(sample, sample[0])
    while len(chosen) < min(n, len(sample)):
        k = int(np.argmax(least))
        if not least[k]:
            break
        chosen.append(k)
        least = np.minimum(least, squared(sample, sample[k]))
    return sample[chosen]


def nearest(q: np.ndarray, q_pivots: np.ndarray, centroids: np.ndarray, c_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row (ties: the smaller number), and how many exact
    distances it took. With the roots' floors a and b, |a - b| - 1 is below the distance."""
    gap = np.abs(q_pivots[:, None, :] - c_pivots[None, :, :]).max(2) - 1
    bound = np.maximum(gap, 0) ** 2
    first = np.argmin(bound, axis=1)
    best, who, measured = squared(q, centroids[first]), first.copy(), len(q)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if not len(rows):
            continue
        measured += len(rows)
        d = squared(q[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], c
    return who, best, measured


def _pivot_table(pivots: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), ROWS):
                batch = whole.slice(a, ROWS)
                near = to_pivots(matrix(batch.column(1), pivots.shape[1]), pivots)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel().tolist() if near.dtype == object else near.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "q", "near"])

    return run


def _assigned(batches: Iterable[pa.RecordBatch], centroids: np.ndarray, c_pivots: np.ndarray):
    for whole in batches:
        for a in range(0, len(whole), ROWS):
            batch = whole.slice(a, ROWS)
            q = matrix(batch.column(1), centroids.shape[1])
            who, best, _ = nearest(q, matrix(batch.column(2), c_pivots.shape[1]), centroids, c_pivots)
            yield batch, q, who, best


def _sums(centroids: np.ndarray, c_pivots: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        n, totals = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for _, q, who, _ in _assigned(batches, centroids, c_pivots):
            n += np.bincount(who, minlength=k)
            for c in np.unique(who):
                totals[c] += q[who == c].sum(0).astype(object)
        rows = [(c, i, int(n[c]), Decimal(int(totals[c, i]))) for c in range(k) if n[c] for i in range(dims)]
        if rows:
            c, i, counts, total = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(counts, pa.int64()), pa.array(total, pa.decimal128(38, 0))], ["cluster", "dim", "n", "total"])

    return run


def _labels(centroids: np.ndarray, c_pivots: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, who, best in _assigned(batches, centroids, c_pivots):
            if len(best) and int(best.max()) >= 1 << 63:
                raise OverflowError("a squared distance is beyond 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who, pa.int32()), pa.array(best.tolist() if best.dtype == object else best, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: every centroid that has vectors becomes the floor of their mean."""
    sums = table.mapInArrow(_sums(centroids, to_pivots(centroids, pivots)), "cluster int, dim int, n long, total decimal(38,0)")
    out = centroids.astype(object)
    for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # at most k x dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return wide(np.array(out.tolist(), object if max(map(abs, out.ravel())) >= 1 << 62 else np.int64))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that integer_vectors keeps.

    Centroids start as the k vectors with the smallest sha256 of `seed:vec_id` (a null vec_id is written null; ties by
    the components); with fewer vectors there are as many centroids. Equal distances go to the smaller number, a centroid
    without vectors stays where it is. Rows that repeat a vec_id are vectors of their own. Distances and inertias are
    exact; a distance or an inertia beyond 64 bits is an error. No kept vector, no rows. Other columns of vectors are not read.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vec_col, dims, scale)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    sample = [r["q"] for r in kept.orderBy(F.sha2(name, 256), "q").limit(max(k, SAMPLE)).collect()]
    if not sample:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sample = wide(np.array(sample, np.int64))
    chosen, centroids = choose_pivots(sample, pivots), sample[:k]
    table = stored(kept.mapInArrow(_pivot_table(chosen), "vec_id long, q array<bigint>, near array<bigint>"), "pivots", compression="zstd")
    for _ in range(rounds):
        after = moved(table, centroids, chosen)
        if (after == centroids).all():
            break  # further rounds would repeat this one
        centroids = after
    labels = stored(table.mapInArrow(_labels(centroids, to_pivots(centroids, chosen)), "vec_id long, cluster int, distance long"), "labels")
    inertia = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    if sum(inertia.values()) >= 1 << 63:
        raise OverflowError("the inertia is beyond 64 bits")
    digests = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, map(int, v))).encode()).hexdigest()) for c, v in enumerate(centroids)]
    about = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
