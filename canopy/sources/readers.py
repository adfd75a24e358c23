"""Readers and writers of the label pipeline's file formats. All schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = "row_id string, attr string, value string, leaf string, score double, tool string, done string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; half-written ones are skipped. A path that doesn't exist gives no rows."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_label_shards(spark: SparkSession, path: str, glob: str = "*", newer_than: str | None = None) -> DataFrame:
    """Label records of all shards under path, without done markers, with `shard` (the file's folder) and `seen` (the file's modification time): the greatest `seen` read is where a later call may resume.

    newer_than: only files modified after this time (`2026-01-31 12:00:00`); older ones are left out when files are listed, and never opened.
    """
    df = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
    df = df.select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("shard"), F.col("_metadata.file_modification_time").alias("seen"))
    if newer_than is not None:
        df = df.filter(F.col("_metadata.file_modification_time") > F.lit(newer_than).cast("timestamp"))
    return df.filter("done is null and row_id is not null").drop("done")


def done_markers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path).filter("done is not null").select(F.col("done").alias("clip")).distinct()


def repair_shard(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Records of clips whose marker has landed."""
    r = records.withColumn("_c", F.substring_index("row_id", ":", 1))
    return r.join(markers.select(F.col("clip").cast("string").alias("_c")).hint("merge"), "_c", "left_semi").drop("_c")


def gold_answers(gold: Column) -> Column:
    """array<struct<is, leaf>> of a gold value of type VARIANT: a string, an object {is, leaf}, or a list of either; null and other values have none."""
    kind = lambda v: F.substring(F.schema_of_variant(v), 1, 5)
    one = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.is", "string"), F.when(kind(v) == "STRIN", F.try_variant_get(v, "$", "string"))).alias("is"), F.try_variant_get(v, "$.leaf", "string").alias("leaf"))
    every = F.when(kind(gold) == "ARRAY", F.try_variant_get(gold, "$", "array<variant>")).otherwise(F.array(gold))
    return F.filter(F.transform(every, one), lambda x: x["is"].isNotNull())


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, source, gold: a map field -> answers (is, leaf), from values that are strings, objects {is, leaf}, or lists of either, parsed once with their line. A row without gold has an empty map."""
    m = spark.read.schema("path string, source string, gold variant").option("mode", "DROPMALFORMED").json(path)
    fields = F.coalesce(F.try_variant_get("gold", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    m = m.withColumn("gold", F.map_from_entries(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), gold_answers(e["value"]).alias("value")))))
    return m if limit is None else m.limit(limit)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """clip, spans: TSV segment_id, t0, t1, label with a header; the clip is the id without its last _part."""
    s = spark.read.schema("segment_id string, t0 double, t1 double, label string").option("sep", "\t").option("header", "true").csv(path)
    s = s.withColumn("clip", F.regexp_replace("segment_id", "_[^_]*$", ""))
    return s.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "label"))).alias("spans"))


def read_multilabel_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, label: CSV id, labels whose quoted second field is a comma-separated list."""
    return spark.read.schema("id string, labels string").option("header", "true").csv(path).select("id", F.explode(F.split("labels", r"\s*,\s*")).alias("label"))


def read_ontology(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, name) and (child, parent) of a JSON array (or, with multi_line false, of lines) of {id, name, child_ids}."""
    o = spark.read.schema("id string, name string, child_ids array<string>").option("multiLine", str(multi_line).lower()).json(path)
    return o.select("id", "name"), o.select(F.explode("child_ids").alias("child"), F.col("id").alias("parent"))


def read_aspects(spark: SparkSession, path: str) -> DataFrame:
    """id, aspect: CSV whose second field is a list of quoted strings."""
    a = spark.read.schema("id string, aspects string").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return a.select("id", F.explode(F.regexp_extract_all("aspects", F.lit(r"(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\")"), F.lit(0))).alias("a")).select("id", F.regexp_replace(F.expr("substring(a, 2, length(a) - 2)"), r"\\(.)", "$1").alias("aspect"))


def read_tab_log(spark: SparkSession, path: str) -> DataFrame:
    """wav, utterance, code of lines `[digit...` with three or more tab-separated fields."""
    f = spark.read.text(path).filter(F.col("value").rlike(r"^\[\d")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 3)
    return f.select(F.regexp_replace(F.col("f")[0], r"^\[\d+\]\s*", "").alias("wav"), F.col("f")[1].alias("utterance"), F.col("f")[2].alias("code"))


def reference_sentences(rows: DataFrame, n: int, lang: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first n distinct sentences of each language, by key."""
    d = rows.groupBy(lang, text).agg(F.min(key).alias(key))
    return d.withColumn("_r", F.row_number().over(W.partitionBy(lang).orderBy(key))).filter(F.col("_r") <= n).select(key, lang, text)


def place_language(rows: DataFrame, aliases: dict[str, str], groups: dict[str, str], lang: str = "lang") -> DataFrame:
    """Adds grp: the language's group after its alias, else `unplaced`."""
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    code = F.coalesce(F.element_at(m(aliases), F.col(lang)), F.col(lang))
    return rows.withColumn("grp", F.coalesce(F.element_at(m(groups), code), F.lit("unplaced")))


def read_items(spark: SparkSession, path: str, drop: list[str], least: int = 2, most: int = 26) -> DataFrame:
    """Parquet items without some categories, with one recording and a bounded number of options."""
    return spark.read.parquet(path).filter(~F.col("category").isin(drop) & (F.size("audio_path") == 1) & F.size("choices").between(least, most))


def multihop_items(meta: DataFrame) -> DataFrame:
    """id, hop, question, options: one row per entry of a map hop -> question text with `A. x` options in it. meta: id, hops."""
    e = meta.select("id", F.explode("hops").alias("hop", "q"))
    return e.select("id", "hop", F.trim(F.regexp_extract("q", r"^(?s)(.*?)(?=\s[A-D]\. )", 1)).alias("question"), F.regexp_extract_all("q", F.lit(r"[A-D]\. (.*?)(?=\s[A-D]\. |$)"), F.lit(1)).alias("options"))


def write_table(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """Replaces a Parquet table; the commit is Spark's."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)


def upsert_features(rows: DataFrame, stored: DataFrame | None, embed, dim_col: str = "x", apart: tuple[str, ...] = (), most: int = 256) -> DataFrame:
    """row_id, x: vectors that are missing from the store, from embed(texts) in batches of at most `most`; unit length. Append the result to the store. rows: row_id, text, and the columns of `apart`.

    A batch never mixes rows that differ in a column of `apart` (clips, grids): rows are dealt and sorted by these, and batches end where one changes.
    """
    need = rows if stored is None else rows.join(stored.select("row_id").hint("merge"), "row_id", "left_anti")
    need = need.select("row_id", "text", F.struct(*[F.col(c).cast("string") for c in apart] or [F.lit("").alias("k")]).cast("string").alias("_k"))
    if apart:
        need = need.repartition("_k").sortWithinPartitions("_k")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(ids, texts):
            x = np.asarray(embed(texts), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(list(x), pa.list_(pa.float32()))], ["row_id", dim_col])

        held, last, kind = [], None, None
        for b in batches:
            kind = b.column("row_id").type
            for i, t, k in zip(*(b.column(c).to_pylist() for c in ("row_id", "text", "_k")), strict=True):
                if held and (k != last or len(held) == most):
                    yield out(*map(list, zip(*held, strict=True)))
                    held = []
                held.append((i, t))
                last = k
        if held:
            yield out(*map(list, zip(*held, strict=True)))

    return need.mapInArrow(run, f"row_id {dict(rows.dtypes)['row_id']}, {dim_col} array<float>")
