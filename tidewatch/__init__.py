"""Spark-first market-surveillance analytics."""
