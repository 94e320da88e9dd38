"""Spark-native analytics over corpora of notes."""
