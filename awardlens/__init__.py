"""Spark-native analytics of public award records."""
