"""Spark-native document retrieval, text analytics and corpus preparation."""
