"""Composite pipelines and the queries over the test tables."""
