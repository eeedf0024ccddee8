"""Spark-native detection, replacement and accounting of sensitive data in text tables."""
