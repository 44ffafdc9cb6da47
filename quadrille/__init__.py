"""Spark-native graph-pattern query engine."""

__version__ = "0.1.0"
