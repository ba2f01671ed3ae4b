"""Typed loaders and writers."""
