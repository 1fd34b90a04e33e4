"""sources of the data-health engine."""
