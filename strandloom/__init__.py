"""Spark-native analytics over genome-anchored tables."""

__version__ = "0.1.0"
