"""Spark-first engine for scientific documents and wide experimental tables."""
