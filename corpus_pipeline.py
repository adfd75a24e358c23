"""From raw documents to packed training sequences: quality, near-duplicates, personal data, mixture, packing.

Every stage but the last returns the columns it got, in their order; columns that it doesn't name pass through. An empty table stays empty. Rows with a null id are never matched with others by
it: they are kept by the quality and near-duplicate stages. Rows that repeat an id share its fate there, and are rows of their own in all other stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import common, mixing, near_dedup, packing, pii, quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the table `labels`, doesn't reject. Null and empty texts are judged by the statistics of an empty one; without labels all are kept."""
    return quality_model.good_documents(docs, common.table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8. Null and empty texts have none and stay."""
    common.reachable(spark)
    return near_dedup.deduplicated(docs, width=5, similarity=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows. Null texts stay null."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document may then occur up to twice, or not at all. Documents without a word are never drawn; a null source is one of its own."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, each window in the mixture's proportions. A null text holds its end mark only."""
    common.reachable(spark)
    return packing.pack(docs, length=2048, added=packing.added_tokens())


STAGES = [("quality", quality), ("near_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("packing", pack)]
#: Trained models, tokens and exact sketches have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
