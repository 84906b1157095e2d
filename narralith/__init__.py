"""Spark-native analytics over texts that carry chains of transmission."""
