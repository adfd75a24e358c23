"""Exact top-k inner products: term-at-a-time accumulation of query rows over blocks of candidates, then selection and merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Vectors in a block; bytes of query blocks that are broadcast at once (one block at least).
BLOCK, BROADCAST_BYTES = 4096, 64 << 20


def _blocks(scale: float):
    """Packs vectors into blocks: ids and integer weights, rows by id; vectors with a null or non-finite part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[int] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            dim = max(map(len, held))
            x = np.zeros((len(held), dim), "<i8")
            for i, v in enumerate(held):
                x[i, : len(v)] = v
            ids = np.array(held_ids, "<i8")
            by = np.argsort(ids, kind="stable")
            held.clear()
            held_ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([ids[by].tobytes()]), pa.array([x[by].tobytes()]), pa.array([dim], pa.int32())], ["ids", "x", "dim"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                flat = v.values if v.is_valid else None
                if i is None or flat is None or flat.null_count or not len(flat):
                    continue
                v = flat.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(v).all():
                    held_ids.append(i)
                    held.append(np.floor(scale * v).astype(np.int64))
                if len(held) == BLOCK:
                    yield out()
        if held:
            yield out()

    return run


def top_of_block(q_ids, q, c_ids, c, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in one block; c_ids ascend, so that ties go to smaller ids."""
    postings = []
    for d in range(c.shape[1]):
        at = np.flatnonzero(c[:, d])
        postings.append((slice(None) if len(at) == len(c) else at, np.ascontiguousarray(c[:, d] if len(at) == len(c) else c[at, d])))
    acc = np.empty(len(c), np.int64)
    for i, row in zip(q_ids.tolist(), q, strict=True):
        acc[:] = 0
        for d in np.flatnonzero(row[: len(postings)]).tolist():
            at, value = postings[d]
            acc[at] += row[d] * value
        own = np.searchsorted(c_ids, [i, i + 1])
        free = np.delete(np.arange(len(c)), np.s_[own[0] : own[1]]) if own[0] < own[1] else None
        scores = acc if free is None else acc[free]
        if not len(scores):
            continue
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else scores.min()
        at = np.flatnonzero(scores >= least)
        at = at[np.argsort(-scores[at], kind="stable")][:k]
        for j, s in zip((at if free is None else free[at]).tolist(), scores[at].tolist(), strict=True):
            yield i, int(c_ids[j]), s


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[c], "<i8") for c in ("q_ids", "ids")]
                x = [np.frombuffer(r[c], "<i8").reshape(len(i), r[d]) for i, c, d in zip(ids, ("q_x", "x"), ("q_dim", "dim"), strict=True)]
                cols = list(zip(*top_of_block(ids[0], x[0], ids[1], x[1], k), strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, group_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query row with all rows of other ids.

    vectors: vec_id, embedding. Components become floor(scale * x); a vector that ends early has zeros there. Ties go to the smaller id. Vectors (or ids) that are
    null, empty, or hold null or non-finite parts take no part. A repeated id is one query more, with the same answers once. Fewer than k candidates give fewer rows.

    Each pair of a query block and a candidate block is one unit of work; its k best per query are all that is shuffled. Query blocks are broadcast in groups of bounded bytes, a pass over
    the candidates for each group; blocks are numbered without their vectors.
    """
    spark = vectors.sparkSession
    schema = "ids binary, x binary, dim int"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = v.filter(is_query).dropDuplicates(["vec_id"])
    n = chosen.count()
    q = chosen.repartition(max(1, -(-n // BLOCK)), "vec_id").mapInArrow(_blocks(scale), schema).withColumn("uid", F.monotonically_increasing_id())
    q = stage(q, "topk-queries")
    order = W.orderBy("uid")
    sizes = q.select("uid", (F.length("ids") + F.length("x")).cast("long").alias("bytes"))
    sizes = sizes.withColumn("part", F.floor((F.sum("bytes").over(order) - F.col("bytes")) / group_bytes).cast("int"))
    numbers = stage(sizes.select("uid", "part", (F.row_number().over(W.partitionBy("part").orderBy("uid")) - 1).alias("b")), "topk-numbers")
    parts = [(r["part"], r["n"]) for r in numbers.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q = q.join(numbers.hint("merge"), "uid").select("part", "b", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("dim").alias("q_dim"))
    c = v.mapInArrow(_blocks(scale), schema)

    def searched(part: int, blocks: int) -> DataFrame:
        each = c.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = each.join(F.broadcast(q.filter(F.col("part") == part).drop("part")), "b").select("q_ids", "q_x", "q_dim", "ids", "x", "dim")
        return both.mapInArrow(_searched(k), "query_id long, vec_id long, score long")

    best = searched(*parts[0])
    for p in parts[1:]:
        best = best.unionByName(searched(*p))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
