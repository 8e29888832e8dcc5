"""Spark-native analytics for two-stage, evidence-based classification of texts."""
