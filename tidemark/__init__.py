"""Tidemark: panel and time-series research on Spark DataFrames."""

__version__ = "0.1.0"
