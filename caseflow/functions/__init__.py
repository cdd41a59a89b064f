"""Scalar column helpers (built-in Spark expressions)."""
