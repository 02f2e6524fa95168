"""Spark-native analytics over version-control history and training corpora."""
