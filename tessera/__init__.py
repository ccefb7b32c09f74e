"""A PySpark-native engine for space-partitioning indexes."""
