"""Spark-native analytics over exchange snapshot streams."""
