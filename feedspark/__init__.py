"""A PySpark-native engine for content-feed analytics."""
