"""Spark-native statistical sequence analytics."""

__version__ = "0.1.0"
