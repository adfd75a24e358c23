"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workers import reachable, shared_folder

#: ASCII white space, as a Java regular expression class and its complement.
WORD = r"[^\x20\x09-\x0D]+"
#: Sides of a join with at most so many (narrow) rows may be broadcast; the number is counted first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs hand at most `rows` rows at once to Python, since rows are whole texts here; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    try:
        if not 0 < int(own) <= rows:
            spark.conf.set(key, str(rows))
        yield
    finally:
        spark.conf.set(key, own)


def stage(df: DataFrame, name: str, codec: str = "lz4", rows: int = 2_000) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, gives real sizes. rows: rows at once in Python."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with arrow_batches(spark, rows):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """big joined with a small table on `on`: broadcast when a count proves it small, else a sort-merge join."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def ordered(df: DataFrame, keys: list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """df range-partitioned and sorted by keys, written out, with pid (number of the range) and idx (place in it).

    The keys should be unique or nearly so: then no range is larger than its share, whatever the skew.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", m)
    out = out.withColumn("pid", F.shiftright("_m", 33)).withColumn("idx", F.col("_m").bitwiseAND((1 << 33) - 1))
    return stage(out.drop("_m"), name)


def with_rank(df: DataFrame, sums: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds to the output of ordered() the rank (from 0) and, for each new name, the sum of a column over earlier rows.

    Two levels: within a range, then over the ranges' totals. by: columns that lead the sort order, so that ranks and
    sums start anew in each of their groups; a group that spans many ranges is no burden to any task.
    """
    sums, by = sums or {}, by or []
    inner = W.partitionBy("pid", *by).orderBy("idx")
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    run = {k: F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in sums.items()}
    df = df.withColumns({"rank": F.row_number().over(inner).cast("long") - 1, **run})
    over = W.partitionBy(*by).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy("pid", *by).agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    base = totals.select(
        F.col("pid").alias("_pid"), *[F.col(b).alias(f"_by_{b}") for b in by], F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_{k}").over(over), F.lit(0)).alias(f"_0{k}") for k in sums],
    )
    cond = F.col("pid") == F.col("_pid")
    for b in by:
        cond &= F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    small = base.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = df.join(F.broadcast(base) if small else base.hint("merge"), cond, "inner")
    out = out.withColumns({"rank": F.col("rank") + F.col("_n0"), **{k: F.col(k) + F.col(f"_0{k}") for k in sums}})
    return out.drop("_pid", "_n0", *[f"_by_{b}" for b in by], *[f"_0{k}" for k in sums])


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ids (one column, doc_id): by broadcast when a count proves ids small, else by a sort-merge join."""
    ids = stage(ids.distinct(), "gone")
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", "left_anti")
