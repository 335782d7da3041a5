"""Spark-first annotation of coordinate-keyed tables."""
