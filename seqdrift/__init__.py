"""Spark-native analytics for drift detection over event-token sequences."""
