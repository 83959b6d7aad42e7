"""Spark-native analytics over service-status event streams."""
