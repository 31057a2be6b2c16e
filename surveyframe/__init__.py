"""Spark-native analytics for repeated count surveys."""
