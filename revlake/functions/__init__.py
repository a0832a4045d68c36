"""Scalar functions as Column expressions, and Arrow functions where Spark has none."""
