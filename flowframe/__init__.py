"""A PySpark-native analytics engine for data larger than memory."""
