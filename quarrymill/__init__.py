"""Spark-native building blocks for text-corpus curation and classifier evaluation."""
