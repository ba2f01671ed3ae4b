"""Graphs as two DataFrames: vertices(id, ...) and edges(src, dst, ...), directed, with parallel edges."""
