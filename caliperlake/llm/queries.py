"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_fingerprints, fill_in_middle, max_score, near_dedup, packing, piece_lattice, pii, repeats, sharding, strata, tiff, token_counts, toxicity
from .common import documents, tokenizer_path

SHARD_BYTES = 4_000_000


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path(), spark.conf.get(token_counts.CACHE_SETTING, None), detail=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.compare_with_edits(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), SHARD_BYTES)


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digests(documents(spark, sf_dir))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.piece_digests(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_digests(documents(spark, sf_dir))


def op12_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op13_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_near_dedup, op4_packing, op5_edit_fingerprints, op6_sharding, op7_tiff, op8_repeats, op9_sentencepiece, op10_pii, op11_fill_in_middle, op12_max_score, op13_strata)
}
ORACLES: dict[str, str] = {"op6_sharding": sharding.oracle(SHARD_BYTES), "op11_fill_in_middle": fill_in_middle.ORACLE, "op12_max_score": max_score.ORACLE, "op13_strata": strata.ORACLE}
