"""Spark-native match-event analytics: sources, segmentation, features, models, reports."""

__version__ = "0.1.0"
