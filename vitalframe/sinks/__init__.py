"""sinks of the data-health engine."""
