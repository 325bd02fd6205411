"""Spark-native document retrieval, text analytics and training-data operators."""
