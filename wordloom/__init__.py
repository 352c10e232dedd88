"""Spark-native corpus and distribution analytics."""
