"""Spark-native analytics over versioned graphs, messy records and text corpora."""
