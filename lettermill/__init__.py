"""Spark-native engine for privacy-preserving analysis of correspondence."""
