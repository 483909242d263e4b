"""The registered queries of the operators, opN_<name>, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.llm import decontamination, jump_sharding, line_dedup, lm_scoring, pii, quality_rules, sentencepiece_sampling, simhash_dedup, tool_calls, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model learned from the documents outside the held fold."""
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, votes' posterior and verdict of every document."""
    return quality_rules.judge(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of entities and disclosing terms of every document."""
    return pii.detect(documents(spark, sf_dir))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked calls of all conversations."""
    return tool_calls.link_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with the number and a hash of their pieces."""
    found = sentencepiece_sampling.encode_sampled(documents(spark, sf_dir))
    return found.select("doc_id", "rank", F.size("pieces").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "log_prob", "perturbed", "inclusion", "round_trip")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    return decontamination.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    return line_dedup.judge(documents(spark, sf_dir))


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return jump_sharding.shard_documents(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model fitted on the labels outside the held fold."""
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ALL = (
    op1_lm_scoring, op2_quality_rules, op3_pii, op4_tool_calls, op5_sentencepiece_sampling, op6_decontamination, op7_simhash_dedup, op8_line_dedup, op9_jump_sharding,
    op10_toxicity,
)
QUERIES = {q.__name__: q for q in _ALL}

ORACLE: dict[str, str] = {"op4_tool_calls": tool_calls.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL}
