"""Parsing, balancing, filtering and rendering of one document; plain Python without Spark."""
