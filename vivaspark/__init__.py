"""Spark-native analytics for sequential, evidence-based assessments."""
