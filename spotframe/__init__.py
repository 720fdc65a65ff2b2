"""Sparse spot-by-feature analytics as Spark DataFrame operators."""
