"""Spark-native analytics over job postings."""
