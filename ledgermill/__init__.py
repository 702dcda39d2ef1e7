"""Spark-native analytics over financial documents and question/answer logs."""
