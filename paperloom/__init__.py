"""Spark-native work on scientific text collections: passages, vectors, graphs, evidence and evaluation."""
