"""Spark-native document ingestion, hybrid retrieval and corpus analytics."""

__version__ = "0.1.0"
