"""Spark-native operators: see README.md."""
