"""Streams: sanitising keeps no state, so that it is the same function; trends are windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.kernel.policy import Policy
from hedgerow.operators import html


def sanitize_stream(stream: DataFrame, column: str, policy: Policy) -> DataFrame:
    return stream.withColumn(column, html.sanitize(column, policy))


def violation_trends(rows: DataFrame, time_col: str, column: str, policy: Policy, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, element, n): discards by time and element, of a stream or a table."""
    found = html.audit(rows.withWatermark(time_col, late) if rows.isStreaming else rows, column, policy)
    counts = found.groupBy(F.window(time_col, window).alias("w"), "element").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "element", "n")
