"""Spark-native analytics for symbolic music and other note-like event data."""
