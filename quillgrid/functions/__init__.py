"""Scalar functions: every one takes and returns Spark columns."""
