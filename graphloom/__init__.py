"""Spark-native corpus graph, retrieval and evaluation library."""
