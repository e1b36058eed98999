"""Spark-first analytics over documents, retrieval indexes, tables, graphs and logs."""

__version__ = "0.1.0"
