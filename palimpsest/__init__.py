"""Spark-native analytics over versioned document collections."""
