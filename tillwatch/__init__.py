"""Spark-native retail monitoring analytics."""
