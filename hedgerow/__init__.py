"""HTML sanitising, auditing and text processing over Spark DataFrames."""
