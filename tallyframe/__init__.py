"""Spark-native analytics for text-labelling evaluations."""
