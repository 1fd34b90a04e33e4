"""A Spark-native data-health engine: profiles, quality, relations, drift, contracts."""
