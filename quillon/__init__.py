"""A PySpark-native analytics engine for personalized product search."""
