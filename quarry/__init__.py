"""Quarry: Spark-native analytics over versioned knowledge records and agent execution logs."""
