"""Spark-native analytics for media-consumption history and corpora."""

__version__ = "0.1.0"
