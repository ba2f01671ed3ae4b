"""Relational operators of the pipelines."""
