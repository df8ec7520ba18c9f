"""Exact integer k-means in which norms of blocks screen the centroids.

A vector is compressed to the norms of its blocks of eight components, computed once and stored beside it. By
Cauchy and Schwarz the inner product of vector and centroid is at most that of their block norms, so
|x|^2 + |c|^2 - 2 * sum(|x_b| * |c_b|) is a lower bound of the squared distance. The centroid of the least bound gets its exact
integer distance first; after it only those whose bound does not exceed the best distance so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut
from newsloom.llm.integer_vectors import ROWS, group_sums, matrix, means, scaled

#: Components of a block.
BLOCK = 8


def block_norms(x: np.ndarray) -> np.ndarray:
    """The squared norm of each block, exactly."""
    return np.add.reduceat(x * x, np.arange(0, x.shape[1], BLOCK), axis=1)


def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances from squared block norms of vectors and of centroids, with room for rounding."""
    a, b = x.astype(np.float64), c.astype(np.float64)
    size = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :]
    return size - 2 * (np.sqrt(a) @ np.sqrt(b).T) - 1e-9 * size - 1


def assign(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed."""
    low = bounds(norms, block_norms(centroids))
    cluster = low.argmin(axis=1)
    first = cluster.copy()
    gap = x - centroids[cluster]
    best = (gap * gap).sum(axis=1)
    done = len(x)
    for j in range(len(centroids)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        if len(rows):
            gap = x[rows] - centroids[j]
            found = (gap * gap).sum(axis=1)
            better = (found < best[rows]) | ((found == best[rows]) & (j < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = found[better], j
            done += len(rows)
    return cluster, best, done


def first_centroids(coded: DataFrame, k: int, dims: int) -> np.ndarray:
    """The vectors of the k ids whose sha256 of ``1:<id>`` is least, in that order; rows of one id in the order of their components."""
    keyed = coded.where("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "code", F.hex("code").alias("text"))
    rows = keyed.orderBy("hash", "text").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.code), "<i4") for r in rows], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every row that takes part.

    Rows take part whose vector has exactly ``dims`` components, none null or non-finite; components become floor(scale * x).
    Rows without an id take part but begin no centroid. Repeated rows count as often as they come. With fewer than k
    ids there are as many centroids as ids' rows; without any, or on an empty table, there are no rows. Other columns are left
    out. Components whose distances would exceed 64 bits end the job with an error.
    """
    coded = scaled(vectors, vector, dims, scale, [F.col(vec_id).cast("long").alias("vec_id")])

    def with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = block_norms(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in norms], pa.binary())], ["vec_id", "code", "norms"])

    stored = cut(coded.mapInArrow(with_norms, "vec_id long, code binary, norms binary"))
    blocks = -(-dims // BLOCK)
    centroids = first_centroids(coded, k, dims)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return matrix(batch.column(1), dims), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(-1, blocks)

    for _ in range(rounds):

        def assigned(batch: pa.RecordBatch, centroids=centroids):
            x, norms = parts(batch)
            yield assign(x, norms, centroids)[0], x

        centroids = means(centroids, *group_sums(stored, assigned, len(centroids), dims))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                nearest, distance, _ = assign(*parts(part), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    found = cut(stored.mapInArrow(last, schema))
    sums = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.element_at(F.array(*(F.lit(sums.get(j, 0)).cast("long") for j in range(len(centroids)))), F.col("cluster") + 1)
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    return found.select("*", own.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
