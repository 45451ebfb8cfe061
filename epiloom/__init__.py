"""Spark-native receptor / antigen evidence engine."""
