"""Operator 13: centroid clustering (Lloyd's rounds) over whole numbers, exact at every step.

A component x becomes floor(scale * x). The vectors are written once to the shared folder as blocks
of at most ``block_rows`` rows; each round is one pass over the blocks. Within a block the squared
distances are |x|^2 - 2 x.c + |c|^2 in float64 BLAS. With r the largest magnitude of a row plus that
of a centroid, d * r^2 bounds every sum on the way: below 2^53 each is a whole number that a double
holds, so the order of the terms does not matter. Rows beyond that bound are done again in 64-bit
integers, those beyond 2^63 in Python's. RDD treeAggregate combines the sums, which are Python
integers; what travels to the driver is clusters x dimensions numbers, however many vectors there are.

Defined results: vectors of another length, and those that are null or hold a component that is
null or not finite (before or after scaling), take no part; repeated rows count each; a null vec_id
is kept and hashed as an empty text; starts of one hash are ordered by their components; with fewer
vectors than clusters there are as many clusters as vectors; an empty table gives no rows. A
distance or inertia that a long cannot hold is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stored

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
BLOCK_ROWS = 4096
LONG = 2**63 - 1
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def whole_vectors(table: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles with whole values."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    floor = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    rows = table.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & finite)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(scaled, floor).alias("v"))


def blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """(ids, n, narrow, v): ``v`` has the block's components, as 32-bit integers if all fit, else as doubles."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                v = column(part, "v").flatten().to_numpy(zero_copy_only=False)
                narrow = bool((np.abs(v) < 2.0**31).all())
                ids = pa.array([column(part, "vec_id").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int32()), pa.array([narrow]), pa.array([v.astype("<i4" if narrow else "<f8").tobytes()], pa.binary())], names=["ids", "n", "narrow", "v"])

    return vectors.mapInArrow(cut, "ids array<bigint>, n int, narrow boolean, v binary")


def rows_of(n: int, narrow: bool, v: bytes) -> np.ndarray:
    return np.frombuffer(v, "<i4" if narrow else "<f8").reshape(n, -1).astype(np.float64)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of equals, and its squared distance (int64, or objects)."""
    c = np.array([[float(y) for y in row] for row in centroids])
    d = x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.abs(x).max(axis=1)[:, None] + np.abs(c).max(axis=1)[None, :]
        bound = (d * reach * reach).max(axis=1)
        square = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    label, fast = np.zeros(len(x), np.int32), bound < 2.0**53
    distance = np.zeros(len(x), np.int64)
    label[fast] = square[fast].argmin(axis=1)
    distance[fast] = square[fast].min(axis=1)
    middle = np.flatnonzero(~fast & (bound < 2.0**62))
    if len(middle):
        whole = np.array(centroids, np.int64)
        far = np.stack([((x[middle].astype(np.int64) - row) ** 2).sum(axis=1) for row in whole], axis=1)
        label[middle], distance[middle] = far.argmin(axis=1), far.min(axis=1)
    large = np.flatnonzero(~fast & ~(bound < 2.0**62))
    if len(large):
        distance = distance.astype(object)
        for i in large.tolist():
            row = [int(y) for y in x[i].tolist()]
            far = [sum((a - b) ** 2 for a, b in zip(row, centre)) for centre in centroids]
            distance[i] = min(far)
            label[i] = far.index(distance[i])
    return label, distance


def total(values: np.ndarray) -> int:
    """The exact sum, which may be beyond 64 bits."""
    if values.dtype == object:
        return sum(values.tolist())
    return (int((values >> 32).sum()) << 32) + int((values & 0xFFFFFFFF).sum())


def summed(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """The exact componentwise sums of each cluster, as Python integers."""
    small = np.abs(x).max(axis=1) < 2.0**32 if len(x) < 2**20 else np.zeros(len(x), bool)
    one_hot = (label[small][None, :] == np.arange(k)[:, None]).astype(np.float64)
    sums = (one_hot @ x[small]).astype(np.int64).astype(object)
    for i in np.flatnonzero(~small).tolist():
        sums[label[i]] += np.array([int(y) for y in x[i].tolist()], object)
    return sums


def cluster_vectors(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each vector that takes part with its cluster, squared distance, both inertias and its centroid's digest."""
    spark = table.sparkSession
    vectors = whole_vectors(table, dimensions, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = vectors.orderBy(digest, "v").limit(clusters).select("v").collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    centroids = [[int(y) for y in row["v"]] for row in starts]
    k = len(centroids)
    held = stored(blocks(vectors, block_rows))
    numbers = held.select("n", "narrow", "v").rdd

    def add(done, block):
        counts, sums, inertia = done
        x = rows_of(*block)
        label, distance = nearest(x, centroids)
        here = [total(distance[label == j]) for j in range(k)]
        return counts + np.bincount(label, minlength=k).astype(object), sums + summed(x, label, k), [a + b for a, b in zip(inertia, here)]

    def join(one, other):
        return one[0] + other[0], one[1] + other[1], [a + b for a, b in zip(one[2], other[2])]

    def gathered():
        nothing = (np.zeros(k, np.int64).astype(object), np.zeros((k, dimensions), np.int64).astype(object), [0] * k)
        return numbers.treeAggregate(nothing, add, join, depth=2)

    for _ in range(rounds):
        counts, sums, _ = gathered()
        centroids = [[int(y) for y in sums[j] // counts[j]] if counts[j] else centroids[j] for j in range(k)]
    inertia = gathered()[2]
    fits = lambda y: y if y <= LONG else None
    each, whole = [fits(y) for y in inertia], fits(sum(inertia))
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]

    def assigned(batches):
        for batch in batches:
            for block in batch.to_pylist():
                label, distance = nearest(rows_of(block["n"], block["narrow"], block["v"]), centroids)
                at = pa.array(label)
                take = lambda values, kind: pa.array(values, kind).take(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["ids"], pa.int64()), at, pa.array([fits(y) for y in distance.tolist()], pa.int64()), take(each, pa.int64()), pa.array([whole] * len(label), pa.int64()), take(names, pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return held.mapInArrow(assigned, RESULT)
