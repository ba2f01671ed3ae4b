"""The transfer aggregate over streams."""
