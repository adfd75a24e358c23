"""What a job needs of its surroundings: importable workers, and a folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Lets Python workers started from now on import this package from where the driver has it (on a cluster, ship it as usual)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [env.get("PYTHONPATH")])])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one is made only where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Sides of a join with at most so many (narrow) rows may be broadcast; the number is counted first.
BROADCAST_ROWS = 200_000


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """big joined with a small table on `on`: broadcast when a count proves it small, else a sort-merge join, which Spark can split at a hot key."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


#: Spark's setting by which a query's shuffle files go when the query ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write go when it is done, and not when the driver next collects its garbage."""
    before = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if before is None else spark.conf.set(FREES, before)


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read back: a plan doesn't grow, columns are still pruned, sizes are known, and lost executors cost one step. The folder goes when the driver ends, or when `discard` is called.

    spent: tables made by cut that nothing reads any more once df is written; they are removed.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "cut")
    with freeing(spark):
        df.write.parquet(path)
    discard(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def dealt(df: DataFrame, key: str, parts: int, *spent: DataFrame, again: bool = True) -> DataFrame:
    """df as by cut, but in `parts` buckets by the hash of a column, which Spark knows when it reads them: groups, windows and joins on keys that hold the column need no exchange.

    again: False where df lies so already, as it is made from such a table without an exchange.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "dealt")
    name = f"dealt_{uuid.uuid4().hex}"
    with freeing(spark):
        (df.repartition(parts, key) if again else df).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    discard(*spent)
    out = spark.table(name)
    out._cut_at, out._named = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the folders of tables made by cut or dealt; others are left alone."""
    for df in tables:
        path = getattr(df, "_cut_at", None)
        if name := getattr(df, "_named", None):
            df.sparkSession.sql(f"drop table if exists {name}")
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
