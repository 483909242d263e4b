"""Documents in files: one for each file, or one for each row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of every file; Spark's sources leave out files of no bytes."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(path)


def write_pages(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
