"""Spark-native knowledge retrieval, graph analytics and corpus processing."""
