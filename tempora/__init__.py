"""Spark-native retrieval analytics over time-aligned content."""
