"""Spark-native tables, documents and archives."""
