"""Scalar functions as Column expressions."""
