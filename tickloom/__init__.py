"""Spark-native analytics for high-frequency financial data."""
