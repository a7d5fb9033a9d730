"""Sparse linear algebra over Spark tables."""
