"""A PySpark-native engine that assembles page evidence into validated tables."""
