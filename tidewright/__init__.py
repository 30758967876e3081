"""Spark-native classification, vector, text-matching and metric operators."""

__version__ = "0.1.0"
