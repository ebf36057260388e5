"""Spark-native engine for document evidence: text, vectors, ranking, structure."""

__version__ = "0.1.0"
