"""A PySpark-native engine for text quality and spelling analytics."""
