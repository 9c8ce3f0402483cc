"""Spark-native graph retrieval and training-data engine."""
