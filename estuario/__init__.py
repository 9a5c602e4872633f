"""Spark-native episode analytics and training-data operators."""
