"""Spark-native analytics for tables of mineral-royalty operations."""

__version__ = "0.1.0"
