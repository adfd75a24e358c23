"""One query per training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import centroids, codes, language, mixing, near_dedup, packing, pii, quality_model, quality_rules, sharding, topk, toxicity, warc
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401


def op7_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op10_hilbert_sharding(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws")


def op4_divergence_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_rule_ensemble(spark, sf_dir):
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), length=2048, added=packing.added_tokens())


def op6_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("complete")


def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=80)


def op11_centroid_clustering(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, salt="2")


def op12_language_id(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    return codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


QUERIES = {"op1_near_dedup": op1_near_dedup, "op3_toxicity": op3_toxicity, "op5_packing": op5_packing, "op6_warc": op6_warc, "op8_top_k": op8_top_k, "op2_mixing": op2_mixing, "op4_divergence_rules": op4_divergence_rules, "op9_rule_ensemble": op9_rule_ensemble, "op7_pii": op7_pii, "op10_hilbert_sharding": op10_hilbert_sharding, "op11_centroid_clustering": op11_centroid_clustering, "op12_language_id": op12_language_id, "op13_vector_codes": op13_vector_codes}
