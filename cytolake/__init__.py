"""Spark-native analytics for single-cell methylation tables."""

__version__ = "0.1.0"
