"""functions of the data-health engine."""
