"""Spark-native analytics over media, document and vector collections."""
