"""A Spark-native engine for time-ordered sensor and event data."""
