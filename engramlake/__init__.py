"""Spark-native analytics over the long-term memory of coding agents."""
