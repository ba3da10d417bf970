"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import (
    ann,
    embed_dedup,
    lm_score,
    minhash_join,
    mixing,
    oracle,
    oracle_rules,
    packing,
    prefix_trie,
    quality,
    quality_rules,
    secret_scan,
    sharding,
    toxicity,
    whitening,
)
from firmlens.llm.common import table


def op1_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    return toxicity.score_documents(docs, labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    return quality.score_documents(docs, labels)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = minhash_join.near_duplicates(docs, minhash_join.JoinConfig(shingle=2))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("posterior")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embed_dedup": op1_embed_dedup,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_packing": op5_packing,
        "op6_mixing": op6_mixing,
        "op7_ann": op7_ann,
        "op8_secret_scan": op8_secret_scan,
        "op9_minhash_join": op9_minhash_join,
        "op10_lm_score": op10_lm_score,
        "op11_whitening": op11_whitening,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_quality_rules": op13_quality_rules,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embed_dedup": oracle.EMBED_DEDUP,
        "op2_sharding": oracle.SHARDING.format(limit=sharding.LIMIT),
        "op6_mixing": oracle.MIXING,
        "op9_minhash_join": oracle.MINHASH_JOIN,
        "op13_quality_rules": oracle_rules.statement(),
    }
