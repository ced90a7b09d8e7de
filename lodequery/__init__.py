"""Lodequery: hybrid retrieval, knowledge graphs and event-log analytics on plain Spark DataFrames."""

__version__ = "0.1.0"
