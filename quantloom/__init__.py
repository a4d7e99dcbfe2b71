"""Spark-native engine for point-in-time market panels and training-data corpora."""
