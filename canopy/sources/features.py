"""A store of vectors by encoder and set of rows, bucketed by row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import upsert_features

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


class FeatureStore:
    """Vectors (row_id, x) in partitions by (encoder, rows), a table bucketed and sorted by row_id.

    Finding what is missing and reading back join on the buckets: only the rows that are asked for are shuffled, never the store. The table lies at `path`, outside the session's warehouse; a new session
    finds its partitions there. Bucket for the store's final size: `buckets` is fixed when it is made.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "features", buckets: int = 64) -> None:
        self.spark, self.name = spark, name
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        spark.sql(f"create table if not exists {name} (row_id string, x array<float>, encoder string, rows string) using parquet partitioned by (encoder, rows) clustered by (row_id) sorted by (row_id) into {buckets} buckets location '{path}'")
        spark.sql(f"msck repair table {name}")

    def stored(self, encoder: str, rows: str) -> DataFrame:
        """row_id, x of one partition."""
        return self.spark.table(self.name).filter((F.col("encoder") == encoder) & (F.col("rows") == rows)).select("row_id", "x")

    def missing(self, asked: DataFrame, encoder: str, rows: str) -> DataFrame:
        """Rows of asked (row_id, ..) without a vector, each id once."""
        new = asked.withColumn("row_id", F.col("row_id").cast("string")).filter("row_id is not null").dropDuplicates(["row_id"])
        return new.join(self.stored(encoder, rows).select("row_id").hint("merge"), "row_id", "left_anti")

    def upsert(self, asked: DataFrame, encoder: str, rows: str, embed, apart: tuple[str, ...] = (), most: int = 256) -> None:
        """Appends unit vectors of the rows that have none. asked: row_id, text and the columns of `apart`, which a batch never mixes; embed(texts) gives a list of vectors."""
        x = upsert_features(self.missing(asked, encoder, rows), None, embed, apart=apart, most=most)
        self._put(x, encoder, rows, "append", "static")

    def replace(self, vectors: DataFrame, encoder: str, rows: str) -> None:
        """Replaces one partition by vectors (row_id, x); the others stay. Vectors that are read from the same partition must be written elsewhere first."""
        self._put(vectors, encoder, rows, "overwrite", "dynamic")

    def _put(self, vectors: DataFrame, encoder: str, rows: str, mode: str, how: str) -> None:
        out = vectors.select(F.col("row_id").cast("string").alias("row_id"), F.col("x").cast("array<float>").alias("x"), F.lit(encoder).alias("encoder"), F.lit(rows).alias("rows"))
        # one writer a bucket, so that a bucket is one file of each write
        n = int(self.spark.sql(f"describe extended {self.name}").filter("col_name = 'Num Buckets'").first()["data_type"])
        own = self.spark.conf.get(OVERWRITE)
        self.spark.conf.set(OVERWRITE, how)  # tables of the catalog heed the session's setting only
        try:
            out.repartition(n, "row_id").write.mode(mode).insertInto(self.name)
        finally:
            self.spark.conf.set(OVERWRITE, own)

    def read(self, asked: DataFrame, encoder: str, rows: str) -> DataFrame:
        """row_id, ord, x in the order of `ord`; x is null where there is no vector, and an id that is asked for twice comes twice. asked: row_id, ord."""
        a = asked.select(F.col("row_id").cast("string").alias("row_id"), "ord")
        return a.join(self.stored(encoder, rows).hint("merge"), "row_id", "left").orderBy("ord", "row_id")
