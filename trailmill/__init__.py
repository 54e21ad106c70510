"""A PySpark-native engine for annotating and scoring robot demonstrations."""
