"""Spark-native ranked text retrieval and collection analytics."""

__version__ = "0.1.0"
