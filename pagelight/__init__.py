"""Spark-native analytics for text recovered from screens and scanned pages."""

__version__ = "0.1.0"
