"""Spark-native analysis of customer feedback: ingestion, topics, surges, search and replies as DataFrame operators."""
