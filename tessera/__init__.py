"""Spark-native analytics over rule and policy knowledge graphs."""
