"""Wardline: Spark-native analytics for web-page risk."""
