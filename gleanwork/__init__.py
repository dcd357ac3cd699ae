"""Spark-first document indexing and search."""
