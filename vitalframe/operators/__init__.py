"""operators of the data-health engine."""
