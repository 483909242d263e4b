"""The corpus pipeline: quality rules, line de-duplication, near-duplicates, decontamination, and sampled encoding.

Every function takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of ``docs``. ``run`` writes each stage to the shared folder and reads it again.

Nulls, empty texts, repeated rows and clashing names are as in the operators; a row that loses all its lines keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.llm import common, decontamination, line_dedup, quality_rules, sentencepiece_sampling, simhash_similar

#: The near-duplicate stage: words of a shingle, and the Jaccard similarity from which texts are duplicates.
SHINGLE = 5
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak supervision doesn't reject."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash_similar.keep_one(docs, SIMILARITY, SHINGLE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document: doc_id, rank, the pieces' ids, their number and hash, and the scores."""
    found = sentencepiece_sampling.encode_sampled(docs)
    return found.select("doc_id", "rank", "pieces", F.size("pieces").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "log_prob", "inclusion", "round_trip")


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("SentencePiece encoding", encode)]

#: EM, fingerprints and sampling have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, f"pipeline-{k}")
    return docs
