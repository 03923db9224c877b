"""Spark-native analytics for step-by-step solution attempts and text corpora."""
