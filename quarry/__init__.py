"""A PySpark-native analytics engine for code intelligence and retrieval."""
