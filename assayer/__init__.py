"""Spark-native bronze / silver / gold analytics for JSON business events."""
