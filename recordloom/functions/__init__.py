"""Recordloom: Spark-native analytics over structured binary records."""
