"""Spark-native curation of versioned machine-learning datasets."""

__version__ = "0.1.0"
