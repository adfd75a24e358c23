"""Centroid clustering of integer vectors, with a progressive search on their Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .walsh import Sums, integers, kept_rows, longs, narrowed, nearest, padded, transform


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: int, salt: str) -> np.ndarray:
    """The integer vectors of the k kept rows with the least SHA-256 of `<salt>:<vec_id>`, ascending; null ids last, equal ids by the vector."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    kept = vectors.select("vec_id", "embedding").mapInArrow(kept_rows(scale, dim), "vec_id long, embedding array<double>")
    rows = kept.withColumn("h", h).orderBy(F.asc_nulls_last("h"), "embedding").limit(k).collect()
    return integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), scale, dim)[1]


def table_of(rows: list) -> np.ndarray:
    """A matrix of whole numbers, one row each."""
    return narrowed(np.array([[int(v) for v in r] for r in rows], object)) if rows else np.zeros((0, 0), np.int64)


def _summed(centroids: np.ndarray, scale: int):
    """Exact sums of the vectors nearest to each centroid, over all batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sums = transform(padded(centroids)), Sums()
        for batch in batches:
            _, x = integers(batch.column("embedding"), scale, centroids.shape[1])
            if len(x):
                sums.add(nearest(transform(padded(x)), c)[0], x)
        yield sums.batch(["cluster"])

    return run


def _assigned(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = transform(padded(centroids))
        for batch in batches:
            which, x = integers(batch.column("embedding"), scale, centroids.shape[1])
            near, far = nearest(transform(padded(x)), c)
            ids = batch.column("vec_id").take(pa.array(which))
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), longs(far // c.shape[1])], ["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors: vec_id, embedding; other columns aren't read. Kept are vectors of exactly dim components, none null or non-finite (or of 2^62 and more once scaled); components become floor(scale * x). Centroids start as
    the k kept vectors with the least SHA-256 of `<salt>:<vec_id>`; each round assigns every vector to the nearest one (ties: the smaller number) and moves each to the floor of its vectors' mean; empty ones stay.
    Rows with a null id are clustered like others and start a centroid only where ids run out; repeated rows count as often as they occur. Fewer than k kept vectors make fewer centroids, none make no rows.
    A distance or sum beyond a long is null.

    Every round is one pass over the column `embedding`, from which each task returns at most k sums of dim components; they alone are shuffled, and k * dim totals reach the driver. Each task transforms
    its vectors and searches coarse to fine (`walsh.nearest`).
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    c = first_centroids(v, k, dim, scale, salt)
    if not len(c):
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return v.sparkSession.createDataFrame([], none)
    for _ in range(rounds):
        sums = v.select("embedding").mapInArrow(_summed(c, scale), "cluster int, at int, total decimal(38,0), n long")
        sums = sums.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # k * dim rows
        new = [list(row) for row in c]
        for r in sums:
            new[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
        c = table_of(new)
    out = stage(v.mapInArrow(_assigned(c, scale), "vec_id long, cluster int, distance long"), "clusters")
    sha = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in c]
    per = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    total = sum(d for d in per.values() if d is not None)
    long = lambda d: int(d) if d is not None and d < 2**63 else None
    facts = out.sparkSession.createDataFrame([(i, long(d), long(total), sha[i]) for i, d in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
