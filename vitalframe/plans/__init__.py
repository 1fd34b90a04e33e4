"""plans of the data-health engine."""
