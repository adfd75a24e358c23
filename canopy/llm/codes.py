"""Product codes of vectors: each part's nearest codebook entry, searched on integer Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import table_of
from .common import BROADCAST_ROWS, stage
from .walsh import Sums, extended, integers, kept_rows, longs, nearest, padded, transform


def _sizes(scale: int):
    """The longest kept vector of a task, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = n = 0
        for batch in batches:
            which, x = integers(batch.column("embedding"), scale)
            dim, n = max(dim, x.shape[1] if len(which) else 0), n + len(which)
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64())], ["dim", "n"])

    return run


def in_parts(x: np.ndarray, parts: int, dim: int) -> np.ndarray:
    """Rows of dim components as parts of equal size, one axis more; shorter rows end in zeros."""
    return extended(x, dim).reshape(len(x), parts, dim // parts)


def _searched(books: list[np.ndarray], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: the vectors' parts, their nearest entries, and the squared distances."""
    size = books[0].shape[1]
    x = in_parts(x, len(books), len(books) * size)
    for p, book in enumerate(books):
        entries = transform(padded(book))
        near, far = nearest(transform(padded(x[:, p])), entries, first=1)
        yield x[:, p], near, far // entries.shape[1]


def _summed(books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            _, x = integers(batch.column("embedding"), scale)
            if len(x):
                for p, (part, near, _) in enumerate(_searched(books, x)):
                    sums.add(near, part, p)
        yield sums.batch(["part", "entry"])

    return run


def _coded(books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, x = integers(batch.column("embedding"), scale)
            found = list(_searched(books, x))
            code = np.stack([near for _, near, _ in found], 1).astype(np.uint8)
            error = sum(far for _, _, far in found)
            keep = [batch.column(c).take(pa.array(which)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([r.tobytes().hex() for r in code], pa.string()), longs(error)], ["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    vectors: vec_id, embedding, label; other columns aren't read. Dropped are vectors that are null or hold null or non-finite components (or of 2^62 and more once scaled). Components become floor(scale * x); vectors
    are cut into equal consecutive parts. Where lengths differ or aren't a multiple of `parts`, vectors end in zeros up to the longest one's next multiple; empty vectors are all zeros. Each part's codebook
    starts as that part of the vectors with the smallest ids (nulls last, equal ids by the vector; at most 256 entries, for two hex digits each). A round moves each entry to the floor of its parts' mean; unused ones stay.
    label_error sums the errors of rows with an equal label, nulls together. Sums beyond a long are null. No kept vector: no rows.

    A pass over the vectors a round; each task returns at most parts * entries sums, and only those are shuffled or reach the driver. Labels' totals come back by broadcast where a count proves them few,
    else by a merge join that Spark can split at a hot label.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    size = v.select("embedding").mapInArrow(_sizes(scale), "dim int, n long").agg(F.max("dim").alias("dim"), F.sum("n").alias("n")).first()
    label = v.schema["label"].dataType.simpleString()
    if not size["n"]:
        return v.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = -(-max(1, size["dim"]) // parts) * parts
    rows = v.select("vec_id", "embedding").mapInArrow(kept_rows(scale), "vec_id long, embedding array<double>").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    _, start = integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), scale)
    books = list(np.moveaxis(in_parts(start, parts, dim), 1, 0))
    for _ in range(rounds):
        sums = v.select("embedding").mapInArrow(_summed(books, scale), "part int, entry int, at int, total decimal(38,0), n long")
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # entries * dim rows
        new = [[list(e) for e in book] for book in books]
        for r in sums:
            new[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]
        books = [table_of(book) for book in new]
    sha = hashlib.sha256(",".join(str(int(x)) for book in books for e in book for x in e).encode()).hexdigest()
    out = stage(v.mapInArrow(_coded(books, scale), f"vec_id long, label {label}, code string, error long"), "codes")
    per = out.groupBy(F.col("label").alias("_label")).agg(F.expr("try_cast(sum(cast(error as decimal(20,0))) as bigint)").alias("label_error"))
    per = stage(per, "codes-labels")
    small = per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = out.join(F.broadcast(per) if small else per.hint("merge"), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
