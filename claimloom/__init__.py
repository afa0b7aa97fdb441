"""Spark-native engine for web evidence and the claims made in it."""
