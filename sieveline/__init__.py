"""Spark-native analytics for image corpora, detector evaluation and training data."""
