"""Spark-native passage retrieval, batch answering and corpus preparation."""
