"""Feature, metric and model operators."""
