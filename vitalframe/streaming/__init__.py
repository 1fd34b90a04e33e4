"""streaming of the data-health engine."""
