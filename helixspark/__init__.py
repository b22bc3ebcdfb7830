"""Spark-native analytics for large tables of annotated variants."""
