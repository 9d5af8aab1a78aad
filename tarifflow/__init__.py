"""Spark-native analytics over semi-structured price documents."""
